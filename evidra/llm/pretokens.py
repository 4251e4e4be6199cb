"""Cutting whole batches of text into byte-level BPE pieces with numpy, and a bounded cache of what is known about a piece.

The pieces are those of the tokenizer file's pattern: contractions ('s 't 're 've 'm 'll 'd),
runs of letters, of digits or of other signs with one leading space, and white space, whose last
character goes to what follows. A piece is known by a 64-bit hash of its code points; the cache
is a table of fixed size in front of a dictionary that is emptied when full.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .common import span_hashes

LETTER, DIGIT, SPACE = 1, 2, 3
_TABLE: list[np.ndarray] = []
#: The characters of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Texts longer than this many characters are cut where a single space parts two words.
LONG = 1 << 19


def classes() -> np.ndarray:
    """Class of every code point: 0 sign, 1 letter, 2 digit, 3 white space."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x34000):
            kind = unicodedata.category(chr(c))[0]
            table[c] = LETTER if kind == "L" else DIGIT if kind == "N" else 0
        table[WHITE] = SPACE
        _TABLE.append(table)
    return _TABLE[0]


def parts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The texts, long ones in several parts that are cut into pieces as the whole is; the number of parts of each."""
    out: list[str] = []
    counts = np.ones(len(texts), np.int64)
    for k, text in enumerate(texts):
        if len(text) <= LONG:
            out.append(text)
            continue
        at, had = 0, len(out)
        while len(text) - at > LONG:
            stop = text.find(" ", at + LONG // 2)
            while stop > 0 and (text[stop - 1].isspace() or text[stop + 1 : stop + 2].isspace() or stop + 1 == len(text) or not text[stop - 1].isalnum()):
                stop = text.find(" ", stop + 1)
            if stop <= 0:
                break
            out.append(text[at:stop])
            at = stop
        out.append(text[at:])
        counts[k] = len(out) - had
    return out, counts


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text; start and end of each piece in it; the pieces' hashes; the number of pieces of each text."""
    whole = "".join(texts)
    n = len(whole)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if n == 0:
        none = np.zeros(0, np.int64)
        return whole, none, none, none.astype(np.uint64), np.zeros(len(texts), np.int64)
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[c]
    first = offsets[:-1][sizes > 0]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[first] = True
    doc = np.zeros(n + 1, bool)
    doc[first] = doc[n] = True
    tail = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~doc[1:n])
    start[tail] = True
    start[tail[c[tail] == 0x20] + 1] = False
    quote = np.flatnonzero(c[:-1] == 0x27)
    quote = quote[start[quote] & (kind[quote + 1] == LETTER) & ~doc[quote + 1]]
    if len(quote):
        a = c[quote + 1]
        one = np.isin(a, [ord(x) for x in "stmd"])
        b = np.where((quote + 2 < n) & ~doc[np.minimum(quote + 2, n)], c[np.minimum(quote + 2, n - 1)], 0)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)
    counts = np.diff(np.searchsorted(starts, offsets))
    return whole, starts, ends, span_hashes(c, starts, ends), counts


class Known:
    """Values of pieces by hash: a table of fixed size, then a dictionary of at most `most` entries."""

    def __init__(self, most: int = 250_000, bits: int = 20) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)
        self.more: dict[int, int] = {}
        self.most = most

    def clear(self) -> None:
        self.keys[:] = 0
        self.more.clear()

    def find(self, whole: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, make: Callable[[list[str]], list[int]]) -> np.ndarray:
        """The value of each piece; make gives those of pieces not known yet."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            keys, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = miss[at]
            listed = keys.tolist()
            values = [self.more.get(k) for k in listed]
            new = [i for i, v in enumerate(values) if v is None]
            if new:
                a, b = starts[at[new]].tolist(), ends[at[new]].tolist()
                for i, v in zip(new, make([whole[x:y] for x, y in zip(a, b, strict=True)]), strict=True):
                    values[i] = v
                if len(self.more) + len(new) > self.most:
                    self.more.clear()
                self.more.update((listed[i], values[i]) for i in new[: self.most])
            found = np.array(values, np.int64)
            out[miss] = found[back]
            where = (keys >> self.shift).astype(np.int64)
            self.keys[where], self.values[where] = keys, found
        return out
