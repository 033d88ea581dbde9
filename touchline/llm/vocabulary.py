"""The words a corpus uses, counted over all of its documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bytesview import Words, buffers, slices
from touchline.session import cut_lineage


@dataclass(frozen=True)
class Vocabulary:
    """Sorted word hashes: ``common`` (mostly written in lower case, in many documents) and ``known``."""

    common: np.ndarray
    known: np.ndarray


def member(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array."""
    if not len(of):
        return np.zeros(len(hashes), dtype=bool)
    at = np.searchsorted(of, hashes)
    return of[np.minimum(at, len(of) - 1)] == hashes


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column(0))
        for i, j in slices(offsets):
            part = offsets[i : j + 1] - offsets[i]
            w = Words(raw[offsets[i] : offsets[j]], part)
            # each word once a document
            order = np.lexsort((w.upper, w.hash, w.text))
            h, t, u = w.hash[order], w.text[order], w.upper[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            h, lower = h[new], ~u[new]
            words, inverse, docs = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(np.bincount(inverse, weights=lower, minlength=len(words)).astype(np.int64)), pa.array(np.full(len(words), 0, dtype=np.int64))],
                names=["h", "docs", "lower", "texts"],
            )
            full = int((np.bincount(w.text, minlength=j - i) > 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([0]), pa.array([full])], names=["h", "docs", "lower", "texts"])


def learn_vocabulary(df: DataFrame, text: str, common_share: float = 0.01, known_share: float = 0.0005, most: int = 400_000) -> Vocabulary:
    """Counts, over all documents, in how many each word stands, and keeps the frequent.

    ``common`` words stand in ``common_share`` of the texts with words and are
    written in lower case in half of them or more; ``known`` words stand in
    ``known_share`` of them, and make up one in ``most`` of all (word, text)
    pairs.  So at most ``most`` words are known, whatever the corpus; the second
    condition is the stricter one only where texts have more than ``most`` *
    ``known_share`` different words on average.  Words are counted as 64-bit
    hashes, per batch before the shuffle; only the kept ones reach the driver.
    """
    counted = (
        df.select(F.col(text).alias("text")).where("text is not null")
        .mapInArrow(_counts, "h long, docs long, lower long, texts long")
        .groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("lower").alias("lower"), F.sum("texts").alias("texts"))
    )
    counted = cut_lineage(counted)
    sums = counted.agg(F.sum("texts"), F.sum("docs")).first()
    total, pairs = sums[0] or 0, sums[1] or 0
    rows = counted.where(F.col("docs") >= max(2.0, known_share * total, pairs / most)).select("h", "docs", "lower").toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    is_common = (rows["docs"].to_numpy() >= common_share * total) & (2 * rows["lower"].to_numpy() >= rows["docs"].to_numpy())
    return Vocabulary(np.sort(h[is_common]), np.sort(h))
