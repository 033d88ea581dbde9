"""Words, lines and documents of an Arrow string column, as numpy arrays.

The UTF-8 buffer of a batch is looked at in place: no Python string is made.
Folding is to lower case for ASCII and Latin-1 letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# byte classes: 0 other, 1 letter, 2 digit
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[65:91] = CLASS[97:123] = 1
CLASS[48:58] = 2
CLASS[128:] = 1

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
            _inverses = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, INVERSE)]))
    return _powers, _inverses


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[first:last], offsets - first


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _tags(raw: np.ndarray, offsets: np.ndarray, longest: int = 80) -> np.ndarray | None:
    """Mask of the bytes of <tags>: '<', a letter or '/', at most ``longest`` bytes, '>' in the same text."""
    lt = np.flatnonzero(raw[:-1] == 60) if len(raw) else np.zeros(0, np.int64)
    if not len(lt):
        return None
    nxt = raw[lt + 1]
    lt = lt[(CLASS[nxt] == 1) | (nxt == 47)]
    gt = np.flatnonzero(raw == 62)
    k = np.searchsorted(gt, lt)
    lt, k = lt[k < len(gt)], k[k < len(gt)]
    end = gt[k]
    fine = (end - lt <= longest) & (np.searchsorted(offsets, lt, side="right") == np.searchsorted(offsets, end, side="right"))
    lt, end = lt[fine], end[fine]
    if not len(lt):
        return None
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(edge, lt, 1)
    np.add.at(edge, end + 1, -1)
    return np.cumsum(edge[:-1]) > 0


class Words:
    """Words of consecutive texts: maximal runs of letters outside <tags>.

    start, end: byte positions; text: index of the text; hash: of the folded
    bytes; upper: whether the first letter is a capital.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        fold = LOWER[raw]
        kind = CLASS[raw]
        c3 = np.flatnonzero(raw[:-1] == 0xC3) + 1 if n else np.zeros(0, np.int64)
        big = c3[(raw[c3] >= 0x80) & (raw[c3] <= 0x9E) & (raw[c3] != 0x97)]
        fold[big] += 32
        for lead, more in ((0xC2, 1), (0xE2, 2), (0xEF, 2), (0xF0, 3)):
            at = np.flatnonzero(raw == lead)
            for k in range(more + 1):
                kind[np.minimum(at + k, n - 1)] = 0
        self.tags = _tags(raw, offsets)
        if self.tags is not None:
            kind[self.tags] = 0
        self.fold, self.kind = fold, kind
        letter = kind == 1
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = letter[:-1]
        before &= ~begins[:n]
        after = np.zeros(n, dtype=bool)
        after[:-1] = letter[1:]
        after &= ~begins[1:]
        self.start = np.flatnonzero(letter & ~before)
        self.end = np.flatnonzero(letter & ~after) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        p, q = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((fold.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
            self.hash = (total[self.end] - total[self.start]) * q[self.start]
        first = raw[self.start]
        upper = (first >= 65) & (first <= 90)
        wide = np.flatnonzero(first == 0xC3)
        second = raw[np.minimum(self.start[wide] + 1, n - 1)]
        upper[wide] = (second >= 0x80) & (second <= 0x9E)
        self.upper = upper

    def touches_digit(self) -> np.ndarray:
        """Whether a digit stands right before or after the word."""
        digit = CLASS[self.raw] == 2
        n = len(self.raw)
        return (digit[np.maximum(self.start - 1, 0)] & (self.start > 0)) | (digit[np.minimum(self.end, n - 1)] & (self.end < n))

    def __len__(self) -> int:
        return len(self.start)


def word_hash(words: list[str]) -> np.ndarray:
    """The hash ``Words`` gives to each of these (a word must be all letters)."""
    column = pa.array(words, type=pa.large_string())
    raw, offsets = buffers(column)
    w = Words(raw, offsets)
    if len(w) != len(words):
        raise ValueError("not single words")
    return w.hash


def per_text(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or number) by text."""
    return np.bincount(index, weights=weights, minlength=n)[:n]
