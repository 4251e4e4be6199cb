"""Language ID by error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells the languages whose codeword
has a 1 there from the others, by hashed character n-grams (1 to 3 letters, words bounded by
blanks). A bit's classifier is linear: the log ratio of the n-gram's frequency in its two classes
of languages, each language counting alike, averaged over the text's n-grams, then scaled and shifted by a logistic fit
on a bounded sample. Decoding is loss-weighted: a codeword's distance is the sum of exp(-margin)
over its bits, each bit weighted by how often its classifier is right; the nearest codeword wins.
The score is the softmax share of the winner, and `ambiguous` tells that it is below a threshold
or the bits fit no codeword well.

N-gram counts cover all training documents: each task sums dense counts per language (a table of
fixed size), so the shuffle is one row per task and language. Codes: all 2**(K-1)-1 ways of
parting K languages up to 7 of them, beyond that a seeded dense code of fixed length.

Edge cases: null text, or one without a letter, is "und" with score 0; with no training document every
row is "und"; equal distances go to the language first in code point order; repeated rows and
null ids are carried through; other columns are not read by a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mix, remainder, slices
from .pretokens import LETTER, classes

BUCKET_BITS, BATCH = 16, 1 << 18
#: At most so many labelled rows (whole, and one of each language at least) fit scale, shift and weight of the bits; all rows count in the n-grams.
SAMPLE = 4000
AMBIGUOUS = 0.5


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text each belongs to (as bounds), and whether a text has a letter."""
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = classes()[c] == LETTER
    c = np.where(letter, c, 32).astype(np.uint64)
    one = c
    ahead = np.concatenate([c, np.zeros(2, np.uint64)])
    two = ahead[1:-1] * np.uint64(0x10001) + one
    three = ahead[2:] * np.uint64(0x100000007) + two
    shift = np.uint64(64 - BUCKET_BITS)
    buckets = [(mix(g + np.uint64(k << 60)) >> shift).astype(np.int32) for k, g in enumerate((one, two, three))]
    blank2 = ~(letter | np.append(letter[1:], False))
    edge = np.zeros(len(c), bool)
    edge[bounds[1:] - 1] = True
    edge2 = edge.copy()
    edge2[np.maximum(bounds[1:] - 2, 0)] = True
    keep = [letter, ~blank2 & ~edge, np.append(letter[1:], False) & ~edge2]
    where = [np.flatnonzero(k) for k in keep]
    has = np.add.reduceat(letter.astype(np.int64), bounds[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    place = np.concatenate(where)
    return np.concatenate([b[w] for b, w in zip(buckets, where, strict=True)]), np.searchsorted(bounds, place, side="right") - 1, has


def codewords(k: int) -> np.ndarray:
    """(languages, bits) of -1 and 1, no column constant or the inverse of another."""
    if k <= 7:
        bits = [[1 if b >> i & 1 else -1 for i in range(k)] for b in range(1, 1 << max(k - 1, 1)) if k > 1] or [[1]]
        return np.array(bits, np.int8).T[:k]
    rng = np.random.default_rng(k)
    best, found = -1, None
    for _ in range(200):
        m = rng.choice([-1, 1], (k, int(np.ceil(10 * np.log2(k))))).astype(np.int8)
        apart = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if apart > best and (np.abs(m.sum(axis=0)) < k).all():
            best, found = apart, m
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    table: np.ndarray  # (buckets, bits) log ratios
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    ambiguous: float = AMBIGUOUS

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of each text and bit; whether it has a letter."""
        bucket, owner, has = grams(texts)
        sums = np.empty((len(texts), self.table.shape[1]))
        for bit in range(self.table.shape[1]):
            sums[:, bit] = np.bincount(owner, self.table[bucket, bit], len(texts))
        return sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None], has

    def decode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, its score, and whether it is ambiguous."""
        margin = np.clip(raw * self.scale + self.shift, -4, 4)
        loss = np.einsum("b,nkb->nk", self.weight, np.exp(-margin[:, None, :] * self.code[None]))
        win = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = 1 / share.sum(axis=1)
        wrong = (margin * self.code[win] < 0) @ self.weight
        return win, score, (score < self.ambiguous) | (wrong > 0.34)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        raw, has = self.raw(texts)
        win, score, unsure = self.decode(raw)
        return [self.languages[w] if h else "und" for w, h in zip(win, has, strict=True)], np.where(has, score, 0.0), unsure | ~has


def calibration(rows: DataFrame, model: Model, each: int) -> list:
    """l, raw (margins of the bits) of the `each` first rows of every language by a hash of id and text, of those with a letter.

    A histogram of the hash by eighths of an octave gives each language's bound, so every language has its rows at any size
    and about a tenth too many are looked at. Margins are computed in tasks; no text leaves them."""
    place = F.xxhash64("k", "t").bitwiseAND((1 << 60) - 1)
    with_letter = rows.where(F.col("t").rlike(r"\p{L}")).withColumn("o", place).withColumn("octave", F.floor(8 * F.log2(F.col("o") + 1)).cast("int"))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in with_letter.groupBy("l", "octave").count().collect():  # 481 rows a language at most
        sizes.setdefault(r["l"], []).append((r["octave"], r["count"]))
    bounds = []
    for name, found in sizes.items():
        octaves, counts = zip(*sorted(found), strict=True)
        bounds.append((name, octaves[min(int(np.searchsorted(np.cumsum(counts), each)), len(octaves) - 1)]))
    if not bounds:
        return []
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", BATCH):
            raw, has = shared.value.raw(part.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("l"), part.column("o"), pa.array([x.astype("<f8").tobytes() for x in raw], pa.binary()), pa.array(has)], ["l", "o", "raw", "has"])

    bound = F.broadcast(rows.sparkSession.createDataFrame(bounds, "l string, last int"))  # one row a language
    margins = with_letter.join(bound, "l").where(F.col("octave") <= F.col("last")).select("l", "o", "t").mapInArrow(run, "l string, o long, raw binary, has boolean").where("has")
    first = Window.partitionBy("l").orderBy("o", "raw")
    return margins.withColumn("i", F.row_number().over(first)).where(F.col("i") <= each).select("l", "raw").orderBy("l", "raw").collect()


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from every row of train with text and language."""
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "t", BATCH):
            names, of = np.unique(np.array(part.column("l").to_pylist(), object), return_inverse=True)
            bucket, owner, _ = grams(part.column("t").to_pylist())
            for k, name in enumerate(names):
                found = np.bincount(bucket[of[owner] == k], minlength=size)
                sums[name] = sums.get(name, 0) + found
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["l", "bucket", "n"])

    summed = rows.select("t", "l").mapInArrow(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    languages = sorted(set(found.column("l").to_pylist()))
    code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int8)
    if not languages:
        return Model([], code, np.zeros((size, 1), np.float32), *(np.ones(1),) * 3)
    counts = np.zeros((len(languages), size))
    counts[np.searchsorted(languages, found.column("l").to_pylist()), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * size)
    table = np.empty((size, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0], share[code[:, b] < 0]
        table[:, b] = np.log(one.mean(axis=0)) - (np.log(other.mean(axis=0)) if len(other) else 0)
    model = Model(languages, code, table, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    each = max(1, sample // len(languages))
    some = calibration(rows, model, each)
    raw = np.array([np.frombuffer(r["raw"], "<f8") for r in some]).reshape(len(some), code.shape[1])
    truth = code[np.searchsorted(languages, [r["l"] for r in some])] if some else np.zeros((0, code.shape[1]))
    for b in range(code.shape[1] if len(raw) else 0):
        x, y = raw[:, b], (truth[:, b] > 0).astype(float)
        if len(languages) > 1 and y.min() == y.max():  # other languages of the bit have no text with a letter
            model.weight[b] = 0.5
            continue
        unit = max(float(x.std()), 1e-9)
        a, c = 1.0, 0.0
        w = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * x / unit + c, -30, 30)))
            a, c = a - 4 * ((w * (p - y) * x / unit).sum() + 1e-3 * a), c - 4 * (w * (p - y)).sum()
        model.scale[b], model.shift[b] = a / unit, c
        model.weight[b] = max((w * ((a * x / unit + c > 0) == (y > 0))).sum() - 0.5, 0.01)
    model.weight /= model.weight.sum() / 4
    return model


def predict(df: DataFrame, model: Model, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred, score and ambiguous."""
    column = text if text in carry else "_text"
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 2**16 rows of one float a bit
    kinds = dict(df.select(*carry).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, BATCH):
            name, score, unsure = shared.value.predict([x or "" for x in part.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(name, pa.string()), pa.array(score), pa.array(unsure)], [*carry, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", lang_pred string, score double, ambiguous boolean"
    return df.select(*carry, *([] if text in carry else [F.col(text).alias("_text")])).mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, carry=("doc_id", "held_out"))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents in one of the learned languages; those without a letter, or that fit no codeword, go."""
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    names = [f"_{i}" for i in range(len(docs.columns))]
    judged = predict(docs.toDF(*names), model, text=names[docs.columns.index("text")], carry=tuple(names))
    return judged.where(~F.col("ambiguous")).select(*names).toDF(*docs.columns)
