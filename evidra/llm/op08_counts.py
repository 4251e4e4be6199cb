"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol a byte in a linked list. The adjacent pairs that have a
merge rule wait in a heap by rank, then place; the lowest is popped again and again, a stale one
is skipped, and its merge makes up to two new pairs. The count is the number of symbols less the
number of merges; no identifiers are given out. Counts of pieces seen before are kept in a cache
of fixed size, so a text costs about one look-up a word.

The work is map-only over batches bounded in bytes. Special strings in a text are one token each,
as the library has it by default: the text is parted there.

Edge cases: null and empty text have 0 tokens; repeated rows and null ids are carried through;
very long texts are cut between words only where the pieces stay the same; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, flat, slices
from .pretokens import Known, parts, pieces

LIMIT, BATCH = 512, 2 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 upwards in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge rules of a tokenizer file, by pair of symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        self.special = [t["content"] for t in content.get("added_tokens", [])]
        self.symbol = [vocabulary[x] for x in byte_letters()]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))

    def count(self, piece: str) -> int:
        """Symbols of the piece's bytes less the merges that are done."""
        raw = piece.encode("utf-8", "surrogatepass")
        n = len(raw)
        symbol = [self.symbol[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, push, pop = self.rules.get, heapq.heappush, heapq.heappop
        heap = [(rule[0], i, rule[1]) for i in range(n - 1) if (rule := get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, made = pop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            rule = get((symbol[i], symbol[j]))
            if rule is None or rule[0] != rank:
                continue
            merges += 1
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if rule := get((made, symbol[k])):
                    push(heap, (rule[0], i, rule[1]))
            h = before[i]
            if h >= 0 and (rule := get((symbol[h], made))):
                push(heap, (rule[0], h, rule[1]))
        return n - merges


_LOADED: dict[str, tuple[Merges, Known]] = {}


def loaded(path: str) -> tuple[Merges, Known]:
    """Rules and cache of this worker."""
    if path not in _LOADED:
        _LOADED[path] = (Merges(path), Known())
    return _LOADED[path]


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of each text."""
    merges, known = loaded(path)
    extra = np.zeros(len(texts), np.int64)
    split: list[str] = []
    owner: list[int] = []
    for k, text in enumerate(texts):
        runs = [text]
        for token in merges.special:
            if token in text:
                runs = [x for run in runs for x in run.split(token)]
        extra[k] = len(runs) - 1
        split += runs
        owner += [k] * len(runs)
    cut, counts = parts(split)
    whole, starts, ends, hashes, each = pieces(cut)
    values = known.find(whole, starts, ends, hashes, lambda new: [merges.count(p) for p in new])
    sums = np.concatenate([[0], np.cumsum(values)])
    per_part = np.diff(sums[np.concatenate([[0], np.cumsum(each)])])
    rows = np.repeat(np.array(owner, np.int64), counts)
    return np.bincount(rows, per_part, len(texts)).astype(np.int64) + extra


def token_counts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, BATCH):
            raw, offsets = flat(part.column(text))
            n = count_texts([x or "" for x in part.column(text).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, text).mapInArrow(run, f"doc_id {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
