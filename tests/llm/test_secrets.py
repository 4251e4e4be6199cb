"""Secret spans against plain Python over single texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from evidra.llm import op13_secrets as op

FIXED = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}
CLASS = re.compile(r"[A-Za-z0-9+/_=-]+")


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def plain(text):
    """Spans as (start, kind number, end): patterns as they stand, every window counted anew."""
    fixed = [(m.start(), i, m.end()) for i, (p, ok) in enumerate(FIXED.values()) for m in p.finditer(text) if ok(m)]
    more = []
    for m in CLASS.finditer(text):
        if len(m[0]) < op.WINDOW or any(re.search(p, m[0], re.I | re.A) for p in op.ALLOW):
            continue
        bits = next(b for _, ranges, b in op.CLASSES if re.fullmatch(f"[{ranges}]+", m[0]))
        high = [i for i in range(m.start(), m.end() - op.WINDOW + 1) if entropy(text[i : i + op.WINDOW]) >= bits - 1e-9]
        joined = []
        for i in high:
            if joined and i < joined[-1][1]:
                joined[-1][1] = i + op.WINDOW
            else:
                joined.append([i, i + op.WINDOW])
        more += [(s, 3, e) for s, e in joined if not any(a <= s and e <= b for a, _, b in fixed)]
    return sorted(fixed + more)


def texts():
    rng = random.Random(7)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = [
        None, "", "é" * 40, "token=12345678", "token=1234567", "TOKEN = 'abcdefgh'; Secret: x", "api_key:api_key=aaaaaaaa", "apikey='password=secret=abcdefghi'", "paſsword=abcdefgh toKen=abcdefgh",
        "AKIA" + "A" * 12, "AKIA" + "B" * 11, "AKIAKIA" + "1" * 12, "a" * 32, "0" * 31, "é" + "0f" * 16 + "g" + "0f" * 16 + "F", "deadbeef" * 5, "Donaudampfschifffahrtsgesellschaftskapitaen", "x" * 5000,
        "see 123e4567-e89b-12d3-a456-426614174000 and sha256-" + pick(b64, 43), "password    =   'pässwörter'", "secret" + " " * 3000 + "x", "token" * 50 + "=abcdefgh", "my_example_" + pick(b64, 40), pick(b64, 700), "ü" + pick(b64, 19) + " " + pick(b64, 20),
        pick("0123456789ABCDEF", 40), pick("abcdefghijklmnopqrstuvwxyz0123456789", 36), "x_y_z_" * 8 + pick(b64, 30) + "a" * 300 + pick(b64, 30),
    ]
    pieces = ["token", "=", '"', " ", "secret:", "AKIA", "é", "\n", "PASSWD", "a", "f0", "Zq", "_", "9", "api_key", "-"]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randrange(200))) for _ in range(60)]
    return out + [" ".join(pick(b64, rng.randrange(1, 60)) for _ in range(20)) for _ in range(10)]


def test_spans_match_plain_python(spark):
    rows = [(i, t, "spans", "k") for i, t in enumerate(texts())] + [(None, "token=abcdefgh", "x", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, key string").repartition(3)
    got = sorted(op.secrets(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows) and op.secrets(df).columns == ["doc_id", "spans"]
    for r, (i, t, *_) in zip(got, rows, strict=True):
        assert r["doc_id"] == i
        assert [(s["start"], op.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]] == plain(t or ""), t
        assert all(s["value"] == t[s["start"] : s["end"]] for s in r["spans"])
    assert op.secrets(df.limit(0)).count() == 0


def test_spans_do_not_cross_rows():
    raw = np.frombuffer(b"token=abcd" b"efghijkl" + b"0" * 20 + b"0" * 20, np.uint8)
    start, kind, end = op.Scanner(op.CLASSES, (), ()).spans(raw, np.array([0, 10, 18, 38, 58]))
    assert not len(start)


def test_stretches_of_long_candidates():
    """Entropies of a run longer than several stretches, against counting each window."""
    raw = np.random.default_rng(1).choice(np.frombuffer(b"abcdefXYZ0123+/", np.uint8), 3 * op.STRETCH + 77)
    run, at, h = op.entropies(raw, np.array([0, 801]), np.array([len(raw), 832]))
    first = run == 0
    assert sorted(at[first].tolist()) == list(range(len(raw) - op.WINDOW + 1)) and sorted(at[~first].tolist()) == list(range(801, 813))
    assert all(abs(v - entropy(raw[a : a + op.WINDOW].tobytes())) < 1e-9 for a, v in zip(at.tolist(), h.tolist(), strict=True))


def test_allow_list(spark):
    secret = "q7Zx9Lw2Rt5Vb8Nm3Kp6Hd"
    df = spark.createDataFrame([(1, f"id {secret} token={secret}")], "doc_id long, text string")
    kinds = lambda **how: [s["kind"] for s in op.secrets(df, **how).first()["spans"]]
    assert kinds() == ["entropy", "assign"] and kinds(allowed=[secret]) == ["assign"] and kinds(allow=["^q7z"]) == ["assign"] and kinds(classes=[("base64", op.CLASSES[-1][1], 9.0)]) == ["assign"]


def test_query_digest(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op.op13_secrets(spark, sf_dir).collect()
    assert len(rows) == len(source)
    found = 0
    for r in rows:
        spans = plain(source[r["doc_id"]] or "")
        say = lambda some: ",".join(f"{op.KINDS[k]}:{s}:{e}" for s, k, e in some)
        base = [x for x in spans if x[1] < 3]
        assert r["base_sha256"] == hashlib.sha256(say(base).encode()).hexdigest() and r["spans"] == say(spans)
        assert [r[f"n_{k}"] for k in op.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        found += len(base)
    assert found > 0
