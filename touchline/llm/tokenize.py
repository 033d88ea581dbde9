"""Byte-level BPE ids of whole texts, merged through a bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts texts before byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Positions by merge rank; the smallest rank is found by find-first-set.

    Three levels of 64-bit words say which ranks have positions: a bit of a
    level stands for a word of the level below.  Positions of one rank come
    out from the left.  Entries are never removed early: who takes one checks
    whether it still holds.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        sizes = [(ranks >> 6) + 1]
        while sizes[-1] > 1:
            sizes.append((sizes[-1] >> 6) + 1 if sizes[-1] > 64 else 1)
        self.levels = [[0] * n for n in sizes]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank
        for level in self.levels:
            word, bit = at >> 6, at & 63
            was = level[word]
            level[word] = was | (1 << bit)
            if was:
                return
            at = word

    def pop(self) -> tuple[int, int] | None:
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[at]
        position = heappop(bucket)
        rank = at
        if not bucket:
            del self.buckets[rank]
            for level in self.levels:
                word, bit = at >> 6, at & 63
                level[word] &= ~(1 << bit)
                if level[word]:
                    break
                at = word
        return rank, position


class Encoder:
    """Ids of texts under a table of byte sequences and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remembered: int = 200_000):
        self.ranks, self.cut, self.remembered = ranks, regex.compile(pattern), remembered
        self.top = max(ranks.values(), default=0) + 1
        self.seen: dict[str, list[int]] = {}
        self.queue = RankQueue(self.top)  # empty again after every pre-token

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of the lowest rank is merged."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # end of the token that begins here
        before = list(range(-1, n - 1))  # begin of the token before
        alive = bytearray(b"\x01") * n
        queue = self.queue
        get = ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                queue.push(r, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            mid = after[i]
            if not alive[i] or mid >= n:
                continue
            end = after[mid]
            if get(piece[i:end]) != rank:
                continue  # stale: one of the two was merged meanwhile
            alive[mid] = 0
            after[i] = end
            if end < n:
                before[end] = i
                r = get(piece[i : after[end]])
                if r is not None:
                    queue.push(r, i)
            left = before[i]
            if left >= 0:
                r = get(piece[left:end])
                if r is not None:
                    queue.push(r, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens; none for an empty one."""
        seen, out = self.seen, []
        for token in self.cut.findall(text):
            ids = seen.get(token)
            if ids is None:
                ids = self.piece(token.encode("utf-8"))
                if len(token) <= 64:
                    if len(seen) >= self.remembered:
                        seen.clear()
                    seen[token] = ids
            out += ids
        return out


def read_ranks(path: str = TOKENIZER) -> bytes:
    """The vocabulary file's bytes, read by the driver (about 1 MB, sent to the tasks)."""
    with open(path, "rb") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary file ('<base64> <rank>' lines), made once a process."""
    key = hashlib.sha1(data).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})
    return _encoders[key]


def token_ids(df: DataFrame, row_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """row_id, ids (array<int>) of every row, in one pass without a shuffle.

    Defined results: empty and null texts have no ids, an empty array; every
    row gives a row, repeated or not, with null ids kept; strings of special
    tokens are ordinary text; texts and pre-tokens of any length are encoded
    whole; other columns are ignored.
    """
    data = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data).encode
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 1000):
                lists = [encode(t) if t else [] for t in texts.slice(at, 1000).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["row_id", "ids"])

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row_id long, ids array<int>")


def token_counts(df: DataFrame, row_id: str, text: str, path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, n_tokens and the columns in ``keep``; 0 for empty and null texts."""
    data = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data).encode
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *(batch.column(2 + k) for k in range(len(keep)))], names=["row_id", "n_tokens", *keep])

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"), *keep)
    kept = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"row_id long, n_tokens long{kept}")
