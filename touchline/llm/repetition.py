"""Share of a text that repeats what it already said."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bytesview import BASE, Words, buffers, per_text, powers, slices
from touchline.llm.textquality import is_prose
from touchline.llm.vocabulary import Vocabulary, member

LOOPS = (1, 2, 3, 4)
ANYWHERE = 5


def _rolling(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of words, and whether it lies within one text."""
    p, q = powers(len(words) + 1)
    with np.errstate(over="ignore"):
        mixed = words.hash ^ (words.hash >> np.uint64(29))
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mixed * p[: len(words)], out=total[1:])
        grams = (total[n:] - total[:-n]) * q[: len(words) + 1 - n]
    return grams, words.text[n - 1 :] == words.text[: len(words) + 1 - n]


def _later(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Positions below n inside any [start, start + length)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def repeats(w: Words, loops: Sequence[int] = LOOPS, anywhere: int = ANYWHERE) -> np.ndarray:
    """Which words repeat what their text already said.

    Rolling hashes of word n-grams; a word is repeated if it lies in an n-gram
    of ``anywhere`` words that stood earlier in the same text, in one of
    ``loops`` words that directly follows its copy, or in a line or sentence
    (of any length) that stood earlier.  Digits, stops and case don't count.
    """
    raw, n, m = w.raw, len(w.offsets) - 1, len(w)
    if not m:
        return np.zeros(0, dtype=bool)
    p, q = powers(max(n, m) + 2)
    salt = p[w.text]  # keeps texts apart
    hit = np.zeros(m, dtype=bool)
    with np.errstate(over="ignore"):
        if m >= anywhere:
            grams, whole = _rolling(w, anywhere)
            at = np.flatnonzero(whole)
            at = at[_later(grams[at] * (salt[at] | np.uint64(1)) + salt[at])]
            hit |= _cover(at, np.full(len(at), anywhere), m)
        for k in loops:
            if m >= 2 * k:
                grams, whole = _rolling(w, k)
                again = np.flatnonzero((grams[k:] == grams[:-k]) & whole[k:] & (w.text[k : len(w.text) + 1 - k] == w.text[: len(w.text) + 1 - 2 * k])) + k
                hit |= _cover(again, np.full(len(again), k), m)
        # units between line ends and sentence stops
        stop = (raw == 10) | (raw == 13) | (raw == 46) | (raw == 33) | (raw == 63)
        unit = np.cumsum(stop)[w.start]
        new = np.ones(m, dtype=bool)
        new[1:] = (unit[1:] != unit[:-1]) | (w.text[1:] != w.text[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, m))
        mixed = w.hash ^ (w.hash >> np.uint64(29))
        total = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum(mixed * p[:m], out=total[1:])
        keys = (total[first + length] - total[first]) * q[first] * np.uint64(3) + length.astype(np.uint64) * BASE
        again = _later(keys * (salt[first] | np.uint64(1)) + salt[first])
        hit |= _cover(first[again], length[again], m)
    return hit


def _shares(w: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(w.offsets) - 1
    size = (w.end - w.start).astype(float)
    return per_text(w.text, n).astype(float), per_text(w.text, n, hit.astype(float)), per_text(w.text, n, size), per_text(w.text, n, size * hit)


def repeated_share(raw: np.ndarray, offsets: np.ndarray, loops: Sequence[int] = LOOPS, anywhere: int = ANYWHERE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By text: words, repeated words (see ``repeats``), characters (bytes) of words, of repeated words."""
    w = Words(raw, offsets)
    return _shares(w, repeats(w, loops, anywhere))


def prose_once(w: Words, hit: np.ndarray, vocabulary: Vocabulary, common_share: float = 0.5, mixed_share: float = 0.2) -> np.ndarray:
    """``is_prose`` of the texts without their repeated words, so that what a text loops doesn't decide."""
    n = len(w.offsets) - 1
    some = np.maximum(per_text(w.text, n, (~hit).astype(float)), 1)
    share = lambda x: per_text(w.text, n, (x & ~hit).astype(float)) / some
    mixed = share(w.touches_digit()) if len(w) else np.zeros(n)
    return is_prose({"common_share": share(member(w.hash, vocabulary.common)), "mixed_share": mixed}, common_share, mixed_share)


def with_prose(df: DataFrame, text: str, vocabulary: Vocabulary, common_share: float = 0.5, mixed_share: float = 0.2) -> DataFrame:
    """Adds prose: whether the text without its repeats is prose under the vocabulary.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
            for i, j in slices(offsets):
                w = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prose_once(w, repeats(w), vocabulary, common_share, mixed_share))], names=[*part.schema.names, "prose"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kept}, prose boolean")


def repetition(df: DataFrame, row_id: str, text: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Per row: row_id, words, repeated_words, share (of words), char_share, prose.

    ``prose`` is whether the words that don't repeat are prose under the
    vocabulary, null without one.  Works on whole texts in Arrow batches without a shuffle.  Defined results:
    null, blank and wordless texts have 0 words and share 0; repeated rows give
    repeated rows; null ids are kept; a text of any length is one unit of work
    (its arrays take about 60 bytes a byte); other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            parts, fine = [], []
            for i, j in slices(offsets):
                w = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = repeats(w)
                parts.append(_shares(w, hit))
                if vocabulary is not None:
                    fine.append(prose_once(w, hit, vocabulary))
            words, rep, chars, rep_chars = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts) if parts else [[]] * 4))
            prose = pa.nulls(len(words), pa.bool_())
            if vocabulary is not None:
                prose = pa.array(np.concatenate(fine) if fine else np.zeros(0, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(words.astype(np.int64)), pa.array(rep.astype(np.int64)),
                    pa.array(rep / np.maximum(words, 1)), pa.array(rep_chars / np.maximum(chars, 1)), prose,
                ],
                names=["row_id", "words", "repeated_words", "share", "char_share", "prose"],
            )

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row_id long, words long, repeated_words long, share double, char_share double, prose boolean")
