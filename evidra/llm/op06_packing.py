"""Packing by concatenation: global offsets from partition totals, then fixed windows.

First pass: every document's identifiers (and the end identifier) are kept, two bytes each, as a
checkpoint in the shared folder, partition by partition. The partitions' token totals, one row
each, are summed into the offset at which every partition begins. Second pass: each partition adds
its own running sum, so every document knows its global offset without any shuffle, and is cut at
the multiples of the window; a document that crosses one leaves a record on either side.

The order is that of the input's partitions and rows. A window holds `window` identifiers and only
the last one of all is not full.

Identifiers come from the tokenizers library, asked once for each piece that a worker's bounded
cache doesn't hold; texts with special strings go to it whole.

Edge cases: null or empty text is one piece with the end identifier alone; repeated rows are packed
each; an empty table gives no pieces; other columns are not read (the pipeline stage needs only id and text).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, slices
from .pretokens import Known, parts, pieces

WINDOW, END, BATCH = 2048, 1, 1 << 19
#: Identifiers that a worker keeps of known pieces; beyond that its cache starts anew.
ARENA = 6_000_000


class Identifiers:
    """Identifiers of texts as the tokenizers library gives them, piece by piece through a cache."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.known = Known()
        self.arena = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _make(self, new: list[str]) -> list[int]:
        """Puts the pieces' identifiers at the end of the arena; gives place * 2**32 + number."""
        out = []
        for k in range(0, len(new), 4096):
            some = [e.ids for e in self.library.encode_batch(new[k : k + 4096], add_special_tokens=False)]
            flat = np.array([i for ids in some for i in ids], self.dtype)
            if self.used + len(flat) > len(self.arena):
                self.arena = np.concatenate([self.arena, np.zeros(max(len(self.arena), len(flat)), self.dtype)])
            self.arena[self.used : self.used + len(flat)] = flat
            for ids in some:
                out.append(self.used << 32 | len(ids))
                self.used += len(ids)
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian identifiers of each text."""
        if self.used > ARENA:
            self.known.clear()
            self.used = 0
        whole_texts = {k: np.array(self.library.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for k, t in enumerate(texts) if any(s in t for s in self.special)}
        split, counts = parts(["" if k in whole_texts else t for k, t in enumerate(texts)])
        whole, starts, ends, hashes, each = pieces(split)
        values = self.known.find(whole, starts, ends, hashes, self._make)
        place, number = values >> 32, values & ((1 << 32) - 1)
        sums = np.concatenate([[0], np.cumsum(number)])
        ids = self.arena[np.repeat(place - sums[:-1], number) + np.arange(sums[-1])]
        at = sums[np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]].tolist()
        return [whole_texts[k] if k in whole_texts else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


_LOADED: dict[str, Identifiers] = {}


def identifiers(path: str) -> Identifiers:
    if path not in _LOADED:
        _LOADED[path] = Identifiers(path)
    return _LOADED[path]


def tokenised(df: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """doc_id, n (identifiers with the end), ids (without it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = identifiers(path)
        width = int(tokens.dtype[-1])
        for part in slices(batches, text, BATCH):
            ids = tokens.of([x or "" for x in part.column(text).to_pylist()])
            n = pa.array([len(x) // width + 1 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(key), n, pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())], ["doc_id", "n", "ids", "width"])

    return df.select(key, text).mapInArrow(run, f"doc_id {dict(df.dtypes)[key]}, n long, ids binary, width int")


def pack(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kept = cut(tokenised(df, path, key, text))
    totals = {r["p"]: int(r["n"]) for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()}
    base, so_far = {}, 0
    for p in sorted(totals):
        base[p], so_far = so_far, so_far + totals[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = base.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            rows: list[tuple] = []
            for row, (n, ids, width) in enumerate(zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                raw = np.append(np.frombuffer(ids, f"<u{width}").astype("<u4"), np.uint32(end)).tobytes()
                done = 0
                while done < n:
                    room = min(n - done, window - (at + done) % window)
                    rows.append((row, done, room, zlib.crc32(raw[4 * done : 4 * (done + room)]), n, (at + done) // window, (at + done) % window))
                    done += room
                at += n
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())
