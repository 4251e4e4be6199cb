"""Scoring, media, language, personal data, packing, counts and near-duplicates against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidra.llm import common, op01_lm, op03_media, op04_language, op05_pii, op06_packing, op08_counts, op10_dedup
from evidra.llm.common import flat, remainder, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_words_match_regex():
    texts = ["", " a  b\tc\x0b", "x", None, "é y z\n", "tail "]
    raw, offsets = flat(pa.array(texts))
    starts, ends, counts = words(raw, offsets)
    found = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    expected = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert found == sum(expected, []) and counts.tolist() == [len(x) for x in expected]


def test_scores_are_the_unigram_base(docs):
    rows = op01_lm.score(docs, remainder("doc_id", 5) == 1).collect()
    texts = read(docs)
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t.translate(ASCII_LOWER)) + ["\0end"]) for i, t in texts]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    counts = Counter(w for i, ws in split if not held(i) for w in ws)
    n, whole = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    expected = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(log10((counts[w] + 0.5) / whole) for w in ws), 6)) for i, ws in split)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected


def test_score_without_training(empty, docs):
    assert op01_lm.score(empty, remainder("doc_id", 5) == 1).count() == 0
    rows = op01_lm.score(docs, remainder("doc_id", 5) >= 0).collect()
    assert {r["train_tokens"] for r in rows} == {0} and all(r["n_known"] == 0 for r in rows)


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(1, 5000, 3000)
    of = (keys % np.uint64(4)).astype(int)
    made = op01_lm.Filter(np.stack([op01_lm.segment(keys[of == k], counts[of == k], 8 * 40_000) for k in range(4)]))
    assert (made.levels(keys) >= op01_lm.level(counts)).all() and (made.levels(keys) == op01_lm.level(counts)).mean() > 0.98
    assert (made.levels(rng.integers(0, 2**63, 3000).astype(np.uint64)) > 0).mean() < 0.05


def test_model_helps_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    follow = {w: rng.integers(0, 300, 3) for w in range(300)}

    def text() -> str:
        w, out = int(rng.integers(300)), []
        for _ in range(60):
            out.append(f"w{w}")
            w = int(follow[w][rng.integers(3)])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(3000)], "doc_id long, text string")
    r = op01_lm.score(df, remainder("doc_id", 5) == 1, dev=300).where("held_out").selectExpr("sum(base_score) b", "sum(score) s", "sum(n_tokens) n").first()
    assert (r["s"] - r["b"]) / r["n"] > 0.5 and r["s"] < 0


def test_g711_and_adpcm_tables():
    assert (int(op03_media.MULAW[0x00]), int(op03_media.MULAW[0x80]), int(op03_media.MULAW[0xFF])) == (-32124, 32124, 0)
    assert (int(op03_media.ALAW[0x2A]), int(op03_media.ALAW[0xAA]), int(op03_media.ALAW[0xD5])) == (-32256, 32256, 8)
    block = np.random.default_rng(0).integers(0, 256, (5, 36), dtype=np.uint8)
    got = op03_media.decode_adpcm(block)
    for k in range(5):  # one sample at a time
        value, index = int(block[k, 0]) | int(np.int8(block[k, 1])) << 8, min(int(block[k, 2]), 88)
        plain = [value]
        for byte in block[k, 4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(op03_media.STEPS[index])
                diff = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(op03_media.MOVES[code & 7])))
                plain.append(value)
        assert got[k].tolist() == plain


def test_media_round_trip(docs, empty):
    rows = op03_media.media_digest(docs).collect()
    stored = defaultdict(list)
    for r in op03_media.media_column(docs).collect():
        stored[r["doc_id"]].append(bytes(r["media"]))
    seen = defaultdict(set)
    for i, t in read(docs):
        raw = t.encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        mine = [r for r in rows if r["doc_id"] == i and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()]
        assert mine and mine[0]["n_bytes"] == len(raw) and mine[0]["payload_bytes"] == len(payload) and mine[0]["tail_crc32"] == zlib.crc32(payload[-32:])
        media = next(m for m in stored[i] if op03_media.load(m)[1] == payload)
        codec, _, pcm = op03_media.load(media)
        assert mine[0]["media_sha256"] == hashlib.sha256(media).hexdigest() and mine[0]["media_bytes"] == len(media)
        assert pcm[::2].tolist() == op03_media.decode(codec, np.frombuffer(payload, np.uint8)).tolist()
        seen[t].add((mine[0]["feature"], mine[0]["media_sha256"]))
    assert all(len(x) == 1 for x in seen.values()) and op03_media.media_digest(empty).count() == 0


def test_language(docs, empty, spark, sf_dir):
    model = op04_language.fit(docs)
    out = {(r["doc_id"], r["lang_pred"]) for r in op04_language.predict(docs, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (7, "und")} <= out and (9, "de") in out and (10, "fr") in out and (1, "en") in out
    none = op04_language.fit(empty)
    assert {r["lang_pred"] for r in op04_language.predict(docs, none).collect()} == {"und"}
    from evidra.llm.common import documents

    truth = {r["doc_id"]: r["lang"] for r in documents(spark, sf_dir).collect()}
    rows = [r for r in op04_language.op4_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert len(rows) > 20 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("k", [2, 3, 4, 9])
def test_codewords_are_apart(k):
    code = op04_language.codewords(k)
    assert code.shape[0] == k and min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= max(1, code.shape[1] // 5)


KINDS = ("email", "ip", "card", "phone")
BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            twice = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            good = (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and sum(twice) % 10 == 0, 10 <= len(digits) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_regex(docs, spark, empty):
    rng = np.random.default_rng(5)
    some = ["a@b.c", "_d@e.f", "1.2.3.4", ".5.6", "00300.1.1.1", "007.0.0.1", "4111111111111111", "-4111 1111-1111 1111", "+1 (555) 010-9999", "+12", "é", "🙂", " ", "\n", "..", "@", "0" * 30, "%+-", "x"]
    fuzz = [(i, "".join(rng.choice(some, rng.integers(0, 12)))) for i in range(400)]
    df = spark.createDataFrame([*fuzz, (998, "9" * 60_000), (999, "a" * 60_000 + "@")], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows = defaultdict(list)
    for r in op05_pii.find(df).collect():
        rows[r["doc_id"]].append(r)
    for i, t in read(df):
        spans = plain_spans(t)
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        mine = [r for r in rows[i] if r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert mine, (i, t, text, rows[i])
        assert [mine[0][f"n_{k}"] for k in KINDS] == [sum(s[1] == j for s in spans) for j in range(4)]
        assert {s for s in mine[0]["spans"].split(",") if s and not s.startswith("term")} == set(filter(None, text.split(",")))
    assert op05_pii.find(empty).count() == 0


def test_disclosing_terms_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(2)
    filler = [f"filler{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    filler = [re.sub("[0-9]", "", f) for f in filler]
    rows = [(i, " ".join(rng.choice(filler, 30))) for i in range(200)]
    rows += [(1000 + i, f"{' '.join(rng.choice(filler, 5))} zanzibarian boss@corp.example {' '.join(rng.choice(filler, 5))}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in op05_pii.find(df).collect()}
    for i, t in rows:
        terms = [tuple(map(int, s.split(":")[1:])) for s in out[i]["spans"].split(",") if s.startswith("term")]
        assert ("zanzibarian" in {t[a:b] for a, b in terms}) == (i >= 1000) and (i >= 1000 or not out[i]["spans"])
    clean = {r["doc_id"]: r["text"] for r in op05_pii.stage_pii(spark, df.selectExpr("*", "length(text) n_chars"), "").collect()}
    assert len(clean) == len(rows) and all(clean[i] == t for i, t in rows if i < 1000) and "boss@" not in clean[1000] and "zanzibarian" not in clean[1000] and "[EMAIL]" in clean[1000]


def test_counts_and_identifiers_match_the_library(docs, empty):
    library = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(7)
    some = ["a", "é", "'s", "'ll", "'re", "'", "  ", " ", "\n", "\t", "1", "½", "…", "!", "中", "'T", "<|endoftext|>", "x'd", "🙂", "\x85", "re", "l", " "]
    fuzz = ["".join(rng.choice(some, rng.integers(0, 30))) for _ in range(1500)]
    expected = [e.ids for e in library.encode_batch(fuzz, add_special_tokens=False)]
    assert op08_counts.count_texts(fuzz, PATH).tolist() == [len(x) for x in expected]
    ids = op06_packing.identifiers(PATH)
    assert [np.frombuffer(x, ids.dtype).tolist() for x in ids.of(fuzz)] == expected
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op08_counts.token_counts(docs, PATH).collect())
    want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in read(docs))
    assert got == want and op08_counts.token_counts(empty, PATH).count() == 0


def test_packing_holds_every_identifier_once(docs, empty):
    library = Tokenizer.from_file(PATH)
    rows = op06_packing.pack(docs, PATH).collect()
    want = Counter(tuple([*library.encode(t, add_special_tokens=False).ids, 1]) for _, t in read(docs))
    place = sorted((r["sequence_id"] * 2048 + r["offset"], r) for r in rows)
    at, current, found = 0, [], Counter()
    pool = list(want.elements())
    for where, r in place:
        assert where == at and r["offset"] + r["length"] <= 2048
        at += r["length"]
        current.append(r)
        if r["start"] + r["length"] == r["doc_tokens"]:
            fits = [p for p in pool if len(p) == r["doc_tokens"] and all(zlib.crc32(np.array(p[c["start"] : c["start"] + c["length"]], "<u4").tobytes()) == c["ids_crc32"] for c in current)]
            assert fits and [c["start"] for c in current] == [0, *np.cumsum([c["length"] for c in current])[:-1]]
            found[fits[0]] += 1
            current = []
    assert found == want and not current and op06_packing.pack(empty, PATH).count() == 0


def test_signatures_are_unbiased():
    texts = ["a b c d e f g " * 5, "a b c d e f g " * 9, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" if i % 40 else f"x{i}" for i in range(200)), "one two", None]
    owner, item, weight = op10_dedup.shingles(*flat(pa.array(texts)))
    first = op10_dedup.signatures(owner, item, weight, len(texts), 20_000)
    sets = [(item[owner == k], weight[owner == k]) for k in range(len(texts))]
    for i, j in ((0, 1), (2, 3), (0, 2)):
        assert abs((first[i] == first[j]).mean() - op10_dedup.similarity(sets[i], sets[j])) < 0.02
    assert np.isinf(first[5]).all()


def plain_classes(texts: list[str]) -> list[int]:
    bags = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(ASCII_LOWER))
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] | bags[j]).values())
            if texts[i] == texts[j] or (both and sum((bags[i] & bags[j]).values()) / both >= 0.8):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_near_duplicate_classes_match_brute_force(docs, empty, spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"t{x}" for x in rng.integers(0, 5000, 120)) for _ in range(25)]
    rows = []
    for k, b in enumerate(base):
        for _ in range(int(rng.integers(1, 7))):
            w = b.split()
            for at in rng.integers(0, 120, int(rng.integers(0, 4))):
                w[at] = f"e{rng.integers(9999)}"
            rows.append(" ".join(w))
    chain = base[0].split()
    for k in range(8):  # every member is near its neighbours only
        chain = [*chain[:-12], *[f"c{k}x{i}" for i in range(6)], *chain[-6:]] if k % 2 else [*[f"d{k}x{i}" for i in range(6)], *chain[6:]]
        rows.append(" ".join(chain))
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(rows)], "doc_id long, text string").unionByName(docs.where("doc_id is not null").select("doc_id", "text").distinct())
    texts = sorted(read(df))
    root = plain_classes([t for _, t in texts])
    want = defaultdict(set)
    for (i, _), r in zip(texts, root):
        want[r].add(i)
    got = defaultdict(set)
    for r in op10_dedup.groups(df).collect():
        got[r["class_id"]].add(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(k == min(v) for k, v in got.items())
    assert op10_dedup.groups(empty).count() == 0


def test_dedup_stage_keeps_one_of_each(docs, spark):
    kept = op10_dedup.stage_dedup(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in kept)[2] == 0 and Counter(r["doc_id"] for r in kept)[1] == 1 and sum(r["doc_id"] is None for r in kept) == 1
    assert kept[0].asDict().keys() == docs.first().asDict().keys()


@pytest.mark.parametrize("most", [1 << 6, 1 << 25])  # a filter that lets nearly all rows pass, and one that tells them apart
def test_dedup_stage_moves_few_texts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rng = np.random.default_rng(4)
    alone = [(i, " ".join(rng.bytes(6).hex() for _ in range(500))) for i in range(1500)]
    copies, nobody = "one text that has many copies", " ".join(rng.bytes(6).hex() for _ in range(500))
    rows = [*alone, *[(4000 + i, f"{t} more") for i, t in alone[:30]], *[(2000 + i, copies) for i in range(700)], (2000, copies)]
    rows += [(None, alone[40][1]), (None, nobody), (None, nobody), (3000, None), (3001, ""), (3002, " ")]
    docs = common.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    jvm = spark.sparkContext._jsc.sc()

    def moved() -> int:
        jvm.listenerBus().waitUntilEmpty(60_000)
        return jvm.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = moved()
    got = read(op10_dedup.stage_dedup(spark, docs, ""))
    assert Counter(got) == Counter([*alone, (2000, copies), (None, nobody), (3000, ""), (3002, " ")])
    assert most < 1 << 20 or moved() - before < sum(len(t or "") for _, t in rows)


def bigrams(rows: int, seed: int = 1) -> list[tuple[int, str]]:
    rng = np.random.default_rng(seed)
    follow = {w: rng.integers(0, 300, 3) for w in range(300)}
    out = []
    for i in range(rows):
        w, text = int(rng.integers(300)), []
        for _ in range(60):
            text.append(f"w{w}")
            w = int(follow[w][rng.integers(3)])
        out.append((i, " ".join(text)))
    return out


def test_filter_grows_with_the_corpus(spark):
    for n in (10**6, 10**8, 4 * 10**9):
        number, width = op01_lm.shape(n)
        assert number * width >= n and width < 1 << 22
    df = spark.createDataFrame([(i, t, False) for i, t in bigrams(400)], "doc_id long, text string, held_out boolean").repartition(3)
    sent = op01_lm.packed(df, ["doc_id", "text", "held_out"])
    counts = Counter()
    for _, t in read(df):
        word, before, _ = op01_lm.tokens(pa.array([t]))
        counts.update(word.tolist() + op01_lm.pair(before, word).tolist() + [int(op01_lm.START)])
    number, _ = op01_lm.shape(24_400)
    parts = {r["batch"]: op01_lm.Batch(op01_lm.unpacked(r["part"]), number) for r in sent.collect()}
    same = []
    for r in op01_lm.answers(sent, 24_400).collect():
        keys = parts[r["batch"]].keys[parts[r["batch"]].segment == r["segment"]]
        true = np.array([counts[k] for k in keys.tolist()])
        assert op01_lm.restored(r["totals"], len(keys)).tolist() == true.tolist() and r["false"] < 0.05
        same += (np.frombuffer(r["above"], np.uint8) == 0).tolist()
    assert np.mean(same) > 0.95


def test_every_training_text_informs_the_ratios(spark):
    df = spark.createDataFrame([(i, t, i % 2 == 1) for i, t in bigrams(16)], "doc_id long, text string, h boolean")
    for rows in (df, df.selectExpr("doc_id", "concat(text, repeat(concat(' ', text), 400)) text", "h")):  # 8 documents; texts of over 100,000 characters
        found = op01_lm.score(rows, rows["h"]).where("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
        assert found["s"] > found["b"] + 1
    copies = df.selectExpr("doc_id", "'a b c d e f' text", "h")
    found = op01_lm.score(copies, copies["h"]).where("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert found["s"] > found["b"] + 1


@pytest.mark.parametrize("both", [True, False])
def test_languages_of_long_texts_or_copies_are_calibrated(spark, both):
    en, de = "the quick brown fox jumps over the lazy dog near the river bank ", "der schnelle braune fuchs springt ueber den faulen hund am ufer des flusses "
    rows = [(i, (en if i % 2 else de + "und noch ein wort ") * (400 if both or i % 2 == 0 else 1), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op04_language.fit(df)
    assert {(r["lang"], r["lang_pred"]) for r in op04_language.predict(df, model, carry=("doc_id", "lang")).collect()} == {("en", "en"), ("de", "de")}
    copies = spark.createDataFrame([(i, [en, de][i % 2], ["en", "de"][i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    for text in ("text", "concat(text, doc_id)"):
        model = op04_language.fit(copies.selectExpr("doc_id", f"{text} text", "lang"), sample=8)
        assert {(r["lang"], r["lang_pred"]) for r in op04_language.predict(copies, model, carry=("doc_id", "lang")).collect()} == {("en", "en"), ("de", "de")}


def test_terms_far_from_the_entity_are_found(spark):
    filler = " ".join(f"filler{i}" for i in range(20)).replace("1", "x")
    rows = [(i, f"Contact:\nx@y.zz\n{filler} Zebrowski {'and so on' * i}") for i in range(4)] + [(i, f"plain words {filler} number {i}") for i in range(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in op05_pii.find(df).collect():
        text = dict(rows)[r["doc_id"]]
        at = [s.split(":")[1:] for s in r["spans"].split(",") if s.startswith("term")]
        assert ("Zebrowski" in {text[int(a) : int(b)] for a, b in at}) == (r["doc_id"] < 4)


def test_a_text_of_twenty_thousand_addresses(spark):
    import time

    text = " ".join(f"10.{i % 250}.{i // 250 % 250}.{i % 199}" for i in range(20_000))
    df = spark.createDataFrame([(j, f"{text} line {j} hostnamea") for j in range(3)] + [(9, None), (10, "plain words")], "doc_id long, text string").selectExpr("*", "'x' row", "'y' spans", "1L n_chars")
    began = time.time()
    out = {r["doc_id"]: r for r in op05_pii.find(df).collect()}
    assert time.time() - began < 60 and [out[j]["n_ip"] for j in (0, 1, 2, 9, 10)] == [20_000] * 3 + [0, 0]
    clean = op05_pii.stage_pii(spark, df, "").where("doc_id = 1").first()
    assert clean["text"].startswith("[IP] [IP] ") and clean["text"].count("[IP]") == 20_000 and "10." not in clean["text"] and clean["n_chars"] == len(clean["text"]) and clean["row"] == "x"


def plain_terms(rows, support=3, generalise=0.75):
    """Flagged (doc_id, term) by counting every pair of term and entity."""
    held, n_t, n_e, n_te, texts = {}, Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        spans = plain_spans(t)
        every = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{4,}", t)]
        n_t.update({w for _, _, w in every})
        entities = {t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b]) for a, k, b in spans}
        held[i] = entities, {w for a, b, w in every if not any(s < b and e > a for s, _, e in spans)}
        n_e.update(entities)
        for e in entities:
            texts[e].add(t)
            for w in held[i][1]:
                n_te[e, w] += 1
                texts[e, w].add(t)
    n = len(rows)
    share = lambda e, w: np.log2(n_te[e, w] * n / (n_t[w] * n_e[e])) / np.log2(n / n_e[e])
    return {(i, w) for i, (es, ws) in held.items() for e in es for w in ws if len(texts[e]) >= support and len(texts[e, w]) >= support and n_e[e] < n and share(e, w) >= generalise}


def test_terms_match_plain_counts(spark):
    rng = np.random.default_rng(12)
    letters = "abcdefghij"
    vocabulary = ["".join(rng.choice(list(letters), 5)) for _ in range(60)]
    entities = ["a@b.cc", "z.y@x.org", "10.1.2.3", "+1 555 010 9999", "4111 1111 1111 1111"]
    rows = []
    for i in range(240):
        k = int(rng.integers(0, 12))
        some = list(rng.choice(vocabulary[:40] if k > 4 else vocabulary[8 * k : 8 * k + 20], 8))
        if k < 5:
            some.insert(int(rng.integers(0, 8)), entities[k])
        if i % 17 == 0:
            some.append(entities[i % 5])
        rows.append((i, " ".join(some) + (" " + "q" * (i % 5) if i % 3 else "")))
    rows += rows[:20]
    df = spark.createDataFrame([(j, t) for j, (_, t) in enumerate(rows)], "doc_id long, text string")
    want = plain_terms(list(enumerate(t for _, t in rows)))
    got = set()
    for r in op05_pii.find(df).collect():
        text = rows[r["doc_id"]][1]
        got |= {(r["doc_id"], text[int(a) : int(b)].lower()) for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind == "term"}
    assert got == want and len(want) > 20


def test_decoding_matches_a_plain_decoder(docs):
    """Loss-weighted decoding, bit by bit and language by language."""
    model = op04_language.fit(docs)
    texts = [t for _, t in read(docs)]
    names, scores, _ = model.predict(texts)
    for t, name, score in zip(texts, names, scores):
        lowered = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        grams = [lowered[i : i + n] for n in (1, 2, 3) for i in range(len(lowered) - n + 1)]
        grams = [g for g in grams if (len(g) == 1 and g != " ") or (len(g) == 2 and g.strip()) or (len(g) == 3 and g[1] != " ")]
        if not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0)
            continue
        bucket, owner, _ = op04_language.grams([t])
        assert len(bucket) == len(grams)
        raw = [np.mean([float(model.table[b, bit]) for b in bucket]) for bit in range(model.code.shape[1])]
        loss = []
        for word in model.code:
            margins = [min(4, max(-4, r * a + c)) for r, a, c in zip(raw, model.scale, model.shift)]
            loss.append(sum(w * np.exp(-m * int(bit)) for w, m, bit in zip(model.weight, margins, word)))
        assert model.languages[int(np.argmin(loss))] == name and abs(score - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-6


def plain_scores(rows):
    """(doc_id -> score) with exact counts in dictionaries in place of the filter; rows: (doc_id, text, held_out)."""
    start = "\0start"
    split = {i: re.findall("[^\x20\x09-\x0d]+", t.translate(ASCII_LOWER)) + ["\0end"] for i, t, _ in rows}
    train = [i for i, _, h in rows if not h]
    pairs = lambda ws: list(zip([start, *ws[:-1]], ws))
    count, both = Counter(), Counter()
    for i in train:
        count.update([start, *split[i]])
        both.update(pairs(split[i]))
    n = sum(c for w, c in count.items() if w != start)
    level = lambda c: c.bit_length()
    kind = lambda q: q if q < 4 else (q + 4) // 2
    size = op01_lm.CLASSES
    seen, drawn = np.zeros((size,) * 3), np.zeros((size,) * 3)
    for i in train:
        own, own_both = Counter([start, *split[i]]), Counter(pairs(split[i]))
        for h, w in pairs(split[i]):
            seen[kind(level(count[h] - own[h])), kind(level(count[w] - own[w])), kind(level(both[h, w] - own_both[h, w]))] += 1
    of = lambda w: kind(level(count[w]))
    for (h, w), c in both.items():
        drawn[of(h), of(w), kind(level(c))] += count[h] * count[w] / n
    histories, words = np.zeros(size), np.zeros(size)
    for w, c in count.items():
        if w != "\0end":
            histories[of(w)] += c
        if w != start:
            words[of(w)] += c
    drawn[:, :, 0] += np.maximum(np.outer(histories, words) / n - drawn.sum(axis=2), 0)
    ratio = op01_lm.ratios(seen, drawn)
    held = defaultdict(list)
    for w, c in count.items():
        if w != start:
            held[level(c)].append(c)
    whole = n + 0.5 * (len(count) - 1 + 1)
    one = lambda q: ((np.mean(held[q]) if held[q] else 1.5 * 2 ** (q - 1) if q else 0) + 0.5) / whole
    return {i: sum(log10(one(level(count[w]))) + ratio[of(h), of(w), kind(level(both[h, w]))] for h, w in pairs(ws)) for i, ws in split.items()}


def test_scores_match_a_model_of_plain_sets(spark, monkeypatch):
    """With a filter so wide that nothing is held by mistake, scores are those of exact sets of n-grams."""
    rows = [(i, t + (" extra end" * (i % 4)), i % 5 == 1) for i, t in bigrams(60)]
    rows += [(100 + i, rows[i][1], False) for i in range(10)] + [(200, "", False), (201, "never seen words", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3)
    tight = {r["doc_id"]: r["score"] for r in op01_lm.score(df, df["h"]).collect()}
    monkeypatch.setattr(op01_lm, "shape", lambda n: (8, 1 << 17))
    got = {r["doc_id"]: r["score"] for r in op01_lm.score(df, df["h"]).collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in got)
    assert np.mean([abs(tight[i] - want[i]) / max(1, len(dict((r[0], r[1]) for r in rows)[i].split())) for i in got]) < 0.1


def test_texts_that_occur_twice_score_apart(spark):
    rng = np.random.default_rng(6)
    follow = rng.integers(0, 3000, (3000, 20))  # as many pairs as tokens: most occur once or a few times
    texts = []
    for _ in range(800):
        w = [int(rng.integers(3000))]
        for _ in range(79):
            w.append(int(follow[w[-1], rng.integers(20)]))
        texts.append(" ".join(f"w{x}" for x in w))
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts + texts[:100])], "doc_id long, text string, h boolean")
    found = {r["doc_id"]: r["score"] / r["n_tokens"] for r in op01_lm.score(df, df["h"]).collect()}
    assert np.mean([found[i] for i in range(100)]) > np.mean([found[i] for i in range(100, 800)]) + 0.05
