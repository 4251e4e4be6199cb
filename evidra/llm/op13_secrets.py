"""Secrets in texts: three fixed kinds, and strings whose windows look random.

Beside the kinds `assign`, `access` and `hex`, candidate strings (runs of ASCII letters, digits and + / _ = -) are
read through a sliding window of WINDOW characters. A window's Shannon entropy comes from counts that one leaving and
one entering character change; the threshold depends on the character classes of the candidate. Windows from the
threshold on become spans of the kind `entropy`, those that overlap as one. Candidates on the allow-list (patterns
found anywhere in them, or whole values) and spans within a span of a fixed kind are suppressed; fixed kinds always stay.

Rows are independent, so nothing is shuffled; each task takes its texts in parts of PART bytes. All candidates of a
part move their windows in step; long ones are cut into stretches of STRETCH windows that share no state, so a text of
one endless token costs as much a byte as any other. Positions are code points, ends are exclusive.

Edge cases: null and empty text have no spans; equal spans of two kinds are both reported; repeated rows are reported
each; null ids stay null; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, slices

KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

WINDOW, STRETCH, PART = 20, 256, 1 << 21
#: Character classes of a candidate from the narrowest, with the entropy (bits a character) from which a window counts: a candidate has the first class that holds all its characters.
CLASSES = (
    ("digits", "0-9", 3.3),
    ("hex", "0-9a-f", 3.0),
    ("HEX", "0-9A-F", 3.0),
    ("lower", "a-z", 4.1),
    ("upper", "A-Z", 4.1),
    ("letters", "A-Za-z", 4.0),
    ("identifier", "a-z0-9_-", 3.6),
    ("base64", "A-Za-z0-9+/_=-", 3.8),
)
#: Patterns (any case) of strings that are no secrets though they look random: placeholders, alphabets, UUIDs, digests that name their algorithm.
ALLOW = (
    "example|sample|placeholder|changeme|dummy|redacted",
    "abcdefgh|qwerty|01234567|12345678|76543210",
    r"(.)\1{7}",
    "^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    "^(?:sha(?:1|256|384|512)|md5)[-=]",
)


def members(ranges: str) -> np.ndarray:
    """True at the byte values of a regular expression's character class."""
    one = re.compile(f"[{ranges}]".encode())
    return np.array([one.match(bytes([b])) is not None for b in range(256)])


HEX, CANDIDATE = members("0-9a-f"), members(CLASSES[-1][1])


def runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true values of at least `least`; a run ends with its row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long_ = ends - starts >= least
    return starts[long_], ends[long_]


def anchored(buffer: bytes, pattern: re.Pattern, places: Sequence[int], offsets: np.ndarray) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches, where every match starts at one of the places (ascending) and ends within its row."""
    stops = offsets[np.searchsorted(offsets, np.asarray(places, np.int64), side="right")] if len(places) else []
    done = 0
    for at, stop in zip(places, stops, strict=True):
        if at >= done and (m := pattern.match(buffer, at, int(stop))):
            done = m.end()
            yield m


def places(buffer: bytes, words: Sequence[bytes]) -> list[int]:
    """Every place of any of the words, ascending."""
    found = set()
    for word in words:
        at = buffer.find(word)
        while at >= 0:
            found.add(at)
            at = buffer.find(word, at + 1)
    return sorted(found)


_WEIGHT = np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))


def entropies(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the run, start of the window, entropy) of every window of the runs: all runs move on in step by incremental counts."""
    windows = ends - starts - WINDOW + 1
    pieces = -(-windows // STRETCH)
    run = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[run] + nth * STRETCH
    number = np.minimum(STRETCH, windows[run] - nth * STRETCH)
    order = np.argsort(-number, kind="stable")  # those with windows left are always the first ones
    run, first, number = run[order], first[order], number[order]
    counts = np.zeros((len(run), 128), np.int8)
    rows = np.arange(len(run))
    for i in range(WINDOW):
        counts[rows, raw[first + i]] += 1
    total = _WEIGHT[counts].sum(axis=1)
    out = [(run, first, np.log2(WINDOW) - total / WINDOW)]
    for step in range(1, int(number.max(initial=0))):
        n = int(np.searchsorted(-number, -step, side="left"))
        at = first[:n] + step
        gone, come = raw[at - 1], raw[at + WINDOW - 1]
        c = counts[rows[:n], gone]
        total[:n] += _WEIGHT[c - 1] - _WEIGHT[c]
        counts[rows[:n], gone] = c - 1
        c = counts[rows[:n], come]
        total[:n] += _WEIGHT[c + 1] - _WEIGHT[c]
        counts[rows[:n], come] = c + 1
        out.append((run[:n], at, np.log2(WINDOW) - total[:n] / WINDOW))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Scanner:
    """Finds spans in a buffer of texts that stand end to end."""

    def __init__(self, classes: Sequence[tuple[str, str, float]], allow: Sequence[str], allowed: Sequence[str]):
        self.classes = [(members(ranges), bits) for _, ranges, bits in classes]
        self.allow = [re.compile(p.encode(), re.IGNORECASE) for p in allow]
        self.allowed = {v.encode() for v in allowed}

    def random(self, raw: np.ndarray, buffer: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the entropy spans."""
        starts, ends = runs(CANDIDATE[raw], offsets, WINDOW)
        told = [s for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if (v := buffer[s:e]) not in self.allowed and not any(p.search(v) for p in self.allow)]
        keep = np.isin(starts, told)
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return starts, ends
        bits = np.full(len(starts), np.inf)
        for holds, least in reversed(self.classes):
            outside = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(~holds[raw], out=outside[1:])
            bits[outside[ends] == outside[starts]] = least
        run, at, h = entropies(raw, starts, ends)
        high = h >= bits[run] - 1e-9
        run, at = run[high], np.sort(at[high])
        if not len(at):
            return at, at
        new = np.r_[True, at[1:] >= at[:-1] + WINDOW]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
        return at[new], at[last] + WINDOW

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, kind, end of all spans by bytes, sorted by start and kind."""
        buffer = raw.tobytes()
        found = [(m.start(), 0, m.end()) for m in anchored(buffer, ASSIGN, places(buffer.lower(), KEYWORDS), offsets) if m.end(1) - m.start(1) >= LEAST["assign"]]
        found += [(m.start(), 1, m.end()) for m in anchored(buffer, ACCESS, places(buffer, [b"AKIA"]), offsets) if m.end() - m.start() >= LEAST["access"]]
        fixed = np.array(found, np.int64).reshape(-1, 3)
        starts, ends = runs(HEX[raw], offsets, LEAST["hex"])
        fixed = np.concatenate([fixed, np.stack([starts, np.full(len(starts), 2), ends], axis=1)])
        starts, ends = self.random(raw, buffer, offsets)
        if len(fixed) and len(starts):  # of the fixed spans that start no later, does the furthest reach as far?
            order = np.argsort(fixed[:, 0], kind="stable")
            reach = np.r_[-1, np.maximum.accumulate(fixed[order, 2])]
            told = reach[np.searchsorted(fixed[order, 0], starts, side="right")] >= ends
            starts, ends = starts[~told], ends[~told]
        every = np.concatenate([fixed, np.stack([starts, np.full(len(starts), 3), ends], axis=1)])
        return tuple(every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))].T)


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", classes: Sequence[tuple[str, str, float]] = CLASSES, allow: Sequence[str] = ALLOW, allowed: Sequence[str] = ()) -> DataFrame:
    """key, spans (kind, start, end, value; by start, then kind) of every row.

    classes: (name, character class, bits from which a window counts); allow: patterns, allowed: whole strings that are no secrets."""
    scanner = Scanner(classes, allow, allowed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            raw, offsets = flat(batch.column("text"))
            start, kind, end = scanner.spans(raw, offsets)
            points = np.zeros(len(raw) + 1, np.int32)
            np.cumsum((raw & 0xC0) != 0x80, out=points[1:], dtype=np.int32)
            row = np.searchsorted(offsets, start, side="right") - 1
            origin = points[offsets[row]]
            values = [raw[s:e].tobytes().decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            items = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kind.tolist()], pa.string()), pa.array(points[start] - origin), pa.array(points[end] - origin), pa.array(values, pa.string())], fields=list(_SPAN))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "spans"])

    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"key {kind}, spans {SPANS}")
    return found.withColumnRenamed("key", key)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return secrets(documents(spark, sf_dir)).select("doc_id", *counts[:3], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), counts[3])
