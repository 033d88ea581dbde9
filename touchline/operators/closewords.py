"""Pairs of words within a few edits of each other, without comparing all with all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stretch(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Where stretch i begins (from 1) and how long it is, if a word of that length is cut into k + 1."""
    base, longer = F.floor(length / (k + 1)), length % (k + 1)
    short = k + 1 - longer  # the first ones are shorter by a letter than the rest
    return (base * i + F.greatest(i - short, F.lit(0)) + 1).cast("int"), (base + (i >= short).cast("int")).cast("int")


def _key(k: Column, length: Column, i: Column, stretch: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), length.cast("int").alias("n"), i.cast("int").alias("i"), stretch.alias("s"))


def close_pairs(left: DataFrame, right: DataFrame, allowed: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """(a, b, d): every a of ``left.a`` and b of ``right.b`` with edit distance d <= allowed(length of a, length of b) <= ``most``.

    If two words differ in k edits and one is cut into k + 1 stretches, one of
    them stands unchanged in the other, moved by k letters at most.  So both
    sides are joined on such stretches (with the number of edits, the length
    of b and the stretch's number) and only those pairs are compared: an
    equi-join on fine keys, complete, whatever the sizes.  Each of left.a and
    right.b should be distinct.  Null words pair with nothing; empty ones only
    with what ``allowed`` lets them, as any others.
    """
    def cut(k: Column) -> Column:
        def one(i: Column) -> Column:
            at, n = _stretch(F.length("b"), k, i)
            return _key(k, F.length("b"), i, F.substring(F.col("b"), at, n))

        return F.transform(F.sequence(F.lit(0), k), one)

    def places(gap: Column) -> Column:
        """The stretches of a that could be those of a word longer by gap."""
        length = F.length("a") + gap
        k = allowed(F.length("a"), length)

        def around(i: Column) -> Column:
            at, n = _stretch(length, k, i)
            first = F.greatest(at - k, F.lit(1))
            last = F.greatest(F.least(at + k, F.length("a") - n + 1), first)
            return F.transform(F.sequence(first, last), lambda p: _key(k, length, i, F.substring(F.col("a"), p.cast("int"), n)))

        return F.when((length >= 0) & (k >= F.abs(gap)), F.flatten(F.transform(F.sequence(F.lit(0), k), around)))

    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), cut))
    index = right.where("b is not null").select("b", F.explode(cuts).alias("__x"))
    probe = left.where("a is not null").select("a", F.explode(F.array_distinct(F.flatten(F.array_compact(F.transform(F.sequence(F.lit(-most), F.lit(most)), places))))).alias("__x"))
    pairs = probe.join(index, "__x").select("a", "b").distinct()
    return pairs.withColumn("d", F.levenshtein("a", "b", most)).where((F.col("d") >= 0) & (F.col("d") <= allowed(F.length("a"), F.length("b"))))
