"""Order inside an entity without one task per entity.

An entity (a half of a match, say) may hold a third of all rows, so a plain
``Window.partitionBy(entity).orderBy(time)`` is one enormous task.  Here the
time axis is cut into buckets; rows are ranked inside a bucket and the number
of rows in earlier buckets, one small row per (entity, bucket), is added.
Neighbour access then goes through chunks of equally many rows.

The entity is always one struct column, so that nulls in a key are equal to
each other in the joins below (a struct with null fields is itself not null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "__k"


def entity(keys: Sequence[str]) -> Column:
    """The key columns as one struct."""
    return F.struct(*[F.col(k).alias(k) for k in keys]).alias(KEY)


def millis(c: str | Column) -> Column:
    """Seconds (double) to whole milliseconds; null for null, NaN and infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 9e12, F.round(c * 1000).cast("long"))


def bucket_of(t: Column, width: int) -> Column:
    """Time bucket; rows without a time come before all others."""
    return F.coalesce(F.floor(t / F.lit(width)), F.lit(-(2**53))).cast("long")


def with_rank(df: DataFrame, t: str, ties: Sequence[str] = (), width: int = 1 << 17, out: str = "__rank", by: str = KEY) -> DataFrame:
    """Adds ``out``: 0, 1, 2, … inside each ``by``, ordered by ``t`` then ``ties``.

    ``t`` is a long column.  Two shuffles of ``df`` at most, neither on ``by``
    alone.  Equal rows get different ranks, in no fixed order among themselves.
    """
    b = df.withColumn("__rank_b", bucket_of(F.col(t), width))
    sizes = b.groupBy(by, "__rank_b").agg(F.count("*").alias("__rank_c"))
    before = Window.partitionBy(by).orderBy("__rank_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "__rank_b", F.coalesce(F.sum("__rank_c").over(before), F.lit(0)).alias("__rank_o"))
    inside = Window.partitionBy(by, "__rank_b").orderBy(F.col(t).asc_nulls_first(), *[F.col(x).asc_nulls_first() for x in ties])
    return (
        b.withColumn("__rank_i", F.row_number().over(inside))
        .join(offsets, [by, "__rank_b"])
        .withColumn(out, F.col("__rank_o") + F.col("__rank_i") - 1)
        .drop("__rank_b", "__rank_i", "__rank_o")
    )


def with_previous(df: DataFrame, value: Column, out: str, rank: str = "__rank", chunk: int = 1024, by: str = KEY) -> DataFrame:
    """Adds ``out``: ``value`` of the row of rank - 1 in the same ``by``.

    ``rank`` must be dense.  The last row of each chunk is also sent to the
    next chunk, so every group holds at most ``chunk`` + 1 rows.
    """
    c = F.floor(F.col(rank) / chunk)
    last = (F.col(rank) % chunk) == chunk - 1
    spread = df.withColumn("__v", value).withColumn(
        "__c", F.explode(F.when(last, F.array(c, c + 1)).otherwise(F.array(c)))
    )
    w = Window.partitionBy(by, "__c").orderBy(rank)
    return (
        spread.withColumn(out, F.lag("__v").over(w))
        .where(F.col("__c") == F.floor(F.col(rank) / chunk))
        .drop("__v", "__c")
    )


def with_neighbours(df: DataFrame, value: Column, out: dict[str, int], rank: str = "__rank", chunk: int = 1024, by: str = KEY) -> DataFrame:
    """Adds columns of ``value`` of the rows at the given distances (-2: two before, 1: the next) in the same ``by``.

    ``rank`` must be dense.  Rows near a chunk's borders are also sent to the
    chunks beyond them, so every group holds little more than ``chunk`` rows.
    """
    c, at = F.floor(F.col(rank) / chunk), F.col(rank) % chunk
    back, ahead = max([0, *(-d for d in out.values())]), max([0, *out.values()])
    places = F.concat(F.array(c), F.when(at >= chunk - back, F.array(c + 1)).otherwise(F.slice(F.array(c), 1, 0)), F.when((at < ahead) & (c > 0), F.array(c - 1)).otherwise(F.slice(F.array(c), 1, 0)))
    spread = df.withColumn("__v", value).withColumn("__c", F.explode(places))
    w = Window.partitionBy(by, "__c").orderBy(rank)
    near = {name: F.lag("__v", -d).over(w) if d < 0 else F.lead("__v", d).over(w) for name, d in out.items()}
    return spread.withColumns(near).where(F.col("__c") == F.floor(F.col(rank) / chunk)).drop("__v", "__c")


def whole_order(half: Column, start: Column) -> Column:
    """One number that orders by half, then by start in milliseconds; nulls first in each."""
    return F.coalesce(half, F.lit(-1)).cast("long") * (1 << 44) + F.coalesce(start, F.lit(-(1 << 42)))


def with_running_max(df: DataFrame, value: Column, out: str, before: bool = False, rank: str = "__rank", chunk: int = 1024, by: str = KEY) -> DataFrame:
    """Adds ``out``: the largest ``value`` of the rows up to this one (``before``: up to the one before), in order of rank.

    Chunks of equally many ranks run by themselves; what a chunk takes over
    from earlier ones is found on one row per chunk.
    """
    spread = df.withColumn("__c", F.floor(F.col(rank) / chunk)).withColumn("__f", value)
    heads = spread.groupBy(by, "__c").agg(F.max("__f").alias("__m"))
    earlier = Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(by, "__c", F.max("__m").over(earlier).alias("__p"))
    inside = Window.partitionBy(by, "__c").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    filled = spread.withColumn("__l", F.max("__f").over(inside))
    return filled.join(carried, [by, "__c"]).withColumn(out, F.greatest("__l", "__p")).drop("__c", "__f", "__l", "__p")


def with_last_flag(df: DataFrame, flag: Column, out: str, rank: str = "__rank", chunk: int = 1024, by: str = KEY) -> DataFrame:
    """Adds ``out``: the rank of the last row at or before this one whose ``flag`` holds."""
    return with_running_max(df, F.when(flag, F.col(rank)), out, rank=rank, chunk=chunk, by=by)


def plain_key(df: DataFrame, keys: Sequence[str], extra: Sequence[Column | str]) -> DataFrame:
    """Unpacks the entity struct into its columns again."""
    return df.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], *extra)


ARROW = {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def fold_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``fold`` for each group's rows (tuples of df's columns) in order.

    Many small groups share a task and its Arrow batches, so a group costs no
    more than its rows; groups may span batches.  schema: (name, type) pairs,
    types being those of ARROW.
    """
    at = [df.columns.index(g) for g in group]
    placed = df.repartition(*group).sortWithinPartitions(*group, *order)
    types = [ARROW[t] for _, t in schema]
    names = [n for n, _ in schema]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                k = tuple(row[i] for i in at)
                if k != key:
                    if held:
                        done.extend(fold(held))
                    key, held = k, []
                    if len(done) >= 10_000:
                        yield out(done)
                        done = []
                held.append(row)
        if held:
            done.extend(fold(held))
        yield out(done)

    return placed.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in schema))
