"""Bigram language model in a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale, q = 1 + floor(log2 c), and an
n-gram is put into a Bloom filter once for every level up to its q. Looking it up probes level
after level until one is missing. The filter is a set of segments (an n-gram's hash names its segment)
of about a million training tokens and 8 bits a token each, so it grows with the corpus and its rate of false
positives does not. No segment is broadcast: the distinct n-grams of about 4 MB of text go to their
segments together with their training counts; the task of a segment merges the counts, sets the bits, answers
with level and exact count, and the answers meet their text again by the number of its batch.

Score. P(w | h) = P1(q(w)) * r(q(h), q(w), q(hw)), made of probe results q alone. P1(q) is the smoothed unigram probability
of a word of level q: the mean count of the distinct training words that probe to that level, plus 0.5, over the base score's
denominator, and 0.5 over it for a word that no level holds; so it sums to one over the vocabulary. r is how often that class of probe results is
seen for real neighbours against words drawn independently, given the first two; so it leaves that sum as it is on average over
the histories of a class, false positives and quantisation are weighed as they occur, and unseen pairs get what is
left. Real neighbours are those of training documents, each looked up with its own text's counts left out (where that lowers the
level, false positives are drawn at the segment's rate). Independent draws are summed exactly: every distinct pair weighs
count(h) * count(w) / n, and what is left over falls on pairs without a count. Levels 0 to 3 are classes of their own, so
a pair that occurs twice is told from one that occurs once.

The base score alone needs exact counts of words, which come with the answers.

Words and ends: as the base score is defined, A-Z lower-cased, parted by ASCII white space, then one end.
64-bit hashes stand for words; within a segment their upper 48 bits.

Edge cases: null and empty text score their end alone; no training document: counts are 0, N is 0 and the base is
log10(0.5 / 0.5) = 0 a token; repeated rows are scored each; null ids belong to training; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, flat, mix, remainder, slices, word_hashes, words

BATCH = 1 << 20
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
LEVELS = 24
HASHES = 3
CLASSES = 15


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token (each text's words, then its end), the hash before it, tokens of each text."""
    h, n = word_hashes(*flat(column))
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(first[-1], np.uint64)
    word = np.ones(len(out), bool)
    word[first[1:] - 1] = False
    out[word] = h
    out[~word] = END
    before = np.concatenate([[START], out[:-1]]).astype(np.uint64)
    before[first[:-1]] = START
    return out, before, n + 1


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + word)


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), at most LEVELS."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS)


def places(key: np.ndarray, q: int, bits: int) -> np.ndarray:
    """(HASHES, n) bit numbers of level q of each key within a segment of `bits` bits."""
    a = mix(key + np.uint64(q * 0x9E3779B9))
    b = mix(a) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) >> np.uint64(20)) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Filter bytes of one segment."""
    out = np.zeros(bits, bool)
    q = level(counts)
    for k in range(1, int(q.max(initial=0)) + 1):
        out[places(keys[q >= k], k, bits).ravel()] = True
    return np.packbits(out, bitorder="little")


@dataclass
class Filter:
    """segments: (number, bytes); a key's top bits name its segment."""

    bytes_: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised count of each key: levels probed until one is missing."""
        number, width = self.bytes_.shape
        raw = self.bytes_.ravel()
        base = (keys % np.uint64(number)).astype(np.int64) * (width * 8)
        out = np.zeros(len(keys), np.int8)
        left = np.arange(len(keys))
        for k in range(1, LEVELS + 1):
            at = places(keys[left], k, width * 8) + base[left]
            hit = np.ones(len(left), bool)
            for row in at:
                hit &= (raw[row >> 3] >> (row & 7).astype(np.uint8) & 1).astype(bool)
            left = left[hit]
            if not len(left):
                break
            out[left] = k
        return out


def kinds(q: np.ndarray) -> np.ndarray:
    """Classes of probe results: levels 0 to 3, then two levels to a class."""
    q = q.astype(np.int64)
    return np.where(q < 4, q, (q + 4) // 2)


def ratios(seen: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """log10 of P(word | before) / P1(word) in each class of (history, word, pair).

    Two priors of eight counts each: the classes one lower (as a text's own counts are left out of seen, a class may never
    be met there that a whole count falls in), and the mean of both sides, which draws the ratio to one."""
    lower = np.zeros_like(seen)
    lower[1:, 1:, 1:] = seen[:-1, :-1, :-1]
    seen = seen + 8 * lower / np.maximum(lower.sum(axis=2, keepdims=True), 1)
    prior = 0.5 * (seen + drawn) / np.maximum((seen + drawn).sum(axis=2, keepdims=True), 1) * 8 + 1e-9
    seen, drawn = seen + prior, drawn + prior
    return np.log10(seen / seen.sum(axis=2, keepdims=True)) - np.log10(drawn / drawn.sum(axis=2, keepdims=True))


def shape(n_tokens: int) -> tuple[int, int]:
    """Number of segments and bytes of each: a byte a training token at every size."""
    number = max(8, n_tokens >> 20)
    return number, max(64, -(-n_tokens // number))


@dataclass
class Batch:
    """The distinct n-grams of some texts, by segment, and where each token's word, history and pair stand among them."""

    part: pa.RecordBatch
    number: int

    def __post_init__(self) -> None:
        word, before, self.n_tokens = tokens(self.part.column("text"))
        keys, at = np.unique(np.concatenate([word, pair(before, word), np.array([START])]), return_inverse=True)
        of = (keys % np.uint64(self.number)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        self.keys, self.segment = keys[order], of[order]
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        at, t = to[at], len(word)
        self.word, self.pair, self.start = at[:t], at[t : 2 * t], at[2 * t]
        self.before = np.concatenate([[self.start], self.word[:-1]])
        self.before[np.cumsum(self.n_tokens) - self.n_tokens] = self.start
        self.owner = np.repeat(np.arange(self.part.num_rows), self.n_tokens)
        self.train = ~np.array(self.part.column("held_out").to_pylist(), bool)

    def counts(self) -> np.ndarray:
        """Count of each n-gram in the training texts; the start's is their number."""
        of = self.train[self.owner]
        out = np.bincount(self.word[of], minlength=len(self.keys)) + np.bincount(self.pair[of], minlength=len(self.keys))
        out[self.start] += self.train.sum()
        return out

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often the n-gram of each token occurs in the token's own text."""
        _, back, times = np.unique(self.owner * len(self.keys) + at, return_inverse=True, return_counts=True)
        return times[back]


def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """batch, part: about 4 MB of text in each, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 * BATCH):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.select(columns).schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_batch(part.select(columns))
            yield pa.RecordBatch.from_arrays([part.column("row").slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "part"])

    return cut(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "batch long, part binary"))


def unpacked(part: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(part).read_next_batch()


def shortened(x: np.ndarray) -> bytes:
    """Non-negative numbers, a byte each; those from 255 on follow in eight."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def restored(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n) if len(blob) > n else 0
    return out


def answers(batches: DataFrame, n_tokens: int) -> DataFrame:
    """batch, segment, totals, above (levels above that of the total, a byte each), false (rate of false positives): what the segment says of each n-gram a batch has sent, in the order of its keys."""
    number, width = shape(n_tokens)

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in found:
            for batch, part in zip(some.column("batch").to_pylist(), some.column("part"), strict=True):
                b = Batch(unpacked(part.as_buffer()), number)
                short, counts = b.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:], b.counts()
                at = np.flatnonzero(np.concatenate([[True], b.segment[1:] != b.segment[:-1]]))
                ends = np.append(at[1:], len(b.segment))
                # byte by byte, as the upper bytes of sorted keys compress
                blobs = [pa.array([f(x[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()) for f, x in ((lambda k: k.T.tobytes(), short), (shortened, counts))]
                yield pa.RecordBatch.from_arrays([pa.array(b.segment[at]), pa.array(np.full(len(at), batch)), *blobs], ["segment", "batch", "keys", "counts"])

    def fill(group: pa.Table) -> pa.Table:
        short = [np.frombuffer(k.as_buffer(), np.uint8).reshape(6, -1).T for k in group.column("keys")]
        ends = np.cumsum([len(k) for k in short])
        keys = np.zeros((ends[-1], 8), np.uint8)
        np.concatenate(short, out=keys[:, :6])
        keys, back = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        times = np.concatenate([restored(c.as_buffer(), len(k)) for c, k in zip(group.column("counts"), short, strict=True)])
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, back, times)
        held = Filter(segment(keys[totals > 0], totals[totals > 0], width * 8)[None])
        above = (held.levels(keys) - level(totals)).astype(np.uint8)
        false = float(np.unpackbits(held.bytes_).mean()) ** HASHES
        spans = list(zip(ends - [len(k) for k in short], ends, strict=True))
        blobs = [pa.array([f(x[back[i:j]]) for i, j in spans], pa.binary()) for f, x in ((shortened, totals), (bytes, above))]
        return pa.table([group.column("batch"), group.column("segment"), *blobs, pa.array(np.full(len(ends), false))], ["batch", "segment", "totals", "above", "false"])

    sent = batches.mapInArrow(send, "segment long, batch long, keys binary, counts binary")
    return sent.groupBy("segment").applyInArrow(fill, "batch long, segment long, totals binary, above binary, false double")


def score(docs: DataFrame, held_out, *, key: str = "doc_id", text: str = "text", dev: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from all rows that aren't held out.

    dev is accepted from callers that bounded the fit, and not used."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    batches = packed(rows, ["doc_id", "text", "held_out"])

    def sizes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in found:
            parts = [unpacked(x.as_buffer()) for x in some.column("part")]
            held = [np.array(part.column("held_out").to_pylist(), bool) for part in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int((words(*flat(part.column("text")))[2] + 1)[~h].sum()) for part, h in zip(parts, held, strict=True)], pa.int64())], ["n"])

    n = batches.mapInArrow(sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number, _ = shape(int(n))
    floor, size = 0.5, CLASSES**3

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(unpacked(left.column("part")[0].as_buffer()), number)
        part, right = b.part, right.sort_by("segment")
        sent = [len(x.as_buffer()) for x in right.column("above")]
        total = np.concatenate([restored(x.as_buffer(), k) for x, k in zip(right.column("totals"), sent, strict=True)])
        q = level(total) + np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in right.column("above")])
        false = np.repeat(np.clip(right.column("false").to_numpy(), 1e-12, 0.999), sent)
        kind = kinds(q)
        cell = ((kind[b.before] * (LEVELS + 1) + q[b.word]) * CLASSES + kind[b.pair]).astype("<u2")
        known = np.bincount(b.owner, total[b.word] > 0, part.num_rows).astype(np.int64)
        base = np.bincount(b.owner, np.log10(total + floor)[b.word], part.num_rows)

        # seen: neighbours of the training texts, each without its own text's counts
        of = b.train[b.owner]
        extra = np.floor(np.log((mix(b.keys ^ np.uint64(0x2545F4914F6CDD1D)).astype(np.float64) + 1) / 2.0**64) / np.log(false)).astype(np.int64)

        def without(at: np.ndarray, own: np.ndarray) -> np.ndarray:
            left_over = level(np.maximum(total[at] - own, 0))
            return kinds(np.where(left_over < level(total[at]), np.minimum(left_over + extra[at], LEVELS), q[at]))

        own_word, own_pair = b.own(b.word), b.own(b.pair)
        own_before = np.concatenate([[1], own_word[:-1]])
        own_before[b.before == b.start] = 1
        k = [without(at, own)[of] for at, own in ((b.before, own_before), (b.word, own_word), (b.pair, own_pair))]
        seen = np.bincount((k[0] * CLASSES + k[1]) * CLASSES + k[2], minlength=size)

        # drawn: every distinct pair of the training texts once, so each of its occurrences weighs one by its count
        weight = total[b.before[of]].astype(float) * total[b.word[of]] / (max(float(n), 1) * np.maximum(total[b.pair[of]], 1))
        drawn = np.bincount(((kind[b.before] * CLASSES + kind[b.word]) * CLASSES + kind[b.pair])[of], weight, size)
        # each occurrence of a word adds one by its count, so distinct words are counted
        mass, distinct = np.bincount(q[b.word[of]], minlength=LEVELS + 1), np.bincount(q[b.word[of]], 1 / total[b.word[of]], LEVELS + 1)
        table = np.concatenate([seen, drawn, np.bincount(kind[b.before[of]], minlength=CLASSES), np.bincount(kind[b.word[of]], minlength=CLASSES), mass, distinct, [false.mean(), 1]])
        stops = np.cumsum(b.n_tokens)
        cells = pa.array([cell[i:j].tobytes() for i, j in zip(stops - b.n_tokens, stops, strict=True)], pa.binary())
        one = lambda x: pa.concat_arrays([x, pa.nulls(1, x.type)])
        columns = [part.column("doc_id"), part.column("held_out"), pa.array(b.n_tokens.astype(np.int64)), pa.array(known), pa.array(base), cells]
        tables = pa.concat_arrays([pa.nulls(part.num_rows, pa.binary()), pa.array([table.astype("<f8").tobytes()], pa.binary())])
        return pa.table([*map(one, columns), tables], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "cells", "table"])

    doc_kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {doc_kind}, held_out boolean, n_tokens long, n_known long, base_score double, cells binary, table binary"
    met = cut(batches.groupBy("batch").cogroup(answers(batches, int(n)).groupBy("batch")).applyInArrow(meet, schema))

    def summed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0.0
        for some in found:
            for x in some.column("table"):
                out = out + np.frombuffer(x.as_buffer(), "<f8")
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at] if len(at) else np.zeros(0))], ["i", "x"])

    table = np.zeros(2 * size + 2 * CLASSES + 2 * (LEVELS + 1) + 2)
    for r in met.where(F.col("table").isNotNull()).select("table").mapInArrow(summed, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row a class
        table[r["i"]] = r["x"]
    seen, drawn, before, word, mass, distinct, false = np.split(table, np.cumsum([size, size, CLASSES, CLASSES, LEVELS + 1, LEVELS + 1]))
    seen, drawn = seen.reshape([CLASSES] * 3), drawn.reshape([CLASSES] * 3)
    rest = np.maximum(before[:, None] * word / max(float(n), 1) - drawn.sum(axis=2), 0)
    rate, every = false[0] / max(false[1], 1), np.arange(LEVELS + 1)
    whole = float(n) + 0.5 * (round(distinct.sum()) + 1)
    ratio = ratios(seen, drawn + rest[:, :, None] * np.bincount(kinds(every), rate**every * (1 - rate), CLASSES))
    mean = np.where(distinct > 0, mass / np.maximum(distinct, 1e-9), 1.5 * 2.0 ** (every - 1)) * (every > 0)
    logs = (ratio[:, kinds(every)] + np.log10((mean + floor) / whole)[None, :, None]).ravel()

    def gained(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in found:
            scores = [logs[np.frombuffer(x.as_buffer(), "<u2")].sum() for x in some.column("cells")]
            base = some.column("base_score").to_numpy() - some.column("n_tokens").to_numpy() * np.log10(whole)
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names[:-1]], pa.array(base), pa.array(np.array(scores, float))], [*names, "score"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    out = met.where(F.col("table").isNull()).select(*names, "cells").mapInArrow(gained, f"doc_id {doc_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), remainder("doc_id", 5) == 1)
