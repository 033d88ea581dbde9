"""Overlapping, nested and gapped intervals to periods and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import KEY, bucket_of, entity, millis, with_rank


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket_ms: int = 1 << 17) -> DataFrame:
    """Merges the intervals of each entity; returns keys, kind, start_ms, end_ms.

    Starts and ends are sorted independently.  With s(k) and e(k) the k-th
    smallest start and end, exactly k intervals have begun and ended by e(k)
    where s(k+1) > e(k): there, and only there, is a gap.  So the rank of every
    distinct start and end is computed (bucketed, see ``ordered``), ends and
    starts are joined on entity and rank, and the surviving boundaries, far
    fewer than the rows, are numbered and paired into periods.

    Defined results: intervals with a null, NaN or infinite end, or whose end
    in milliseconds is not after the start, are left out; touching intervals
    belong together; repeated rows change nothing; null keys form an entity of
    their own; an entity without a valid interval gives no row; other columns
    of ``df`` are ignored whatever their names.
    """
    base = (
        df.select(entity(keys), millis(start).alias("__s"), millis(end).alias("__e"))
        .where(F.col("__e") > F.col("__s"))
    )
    edge = (
        base.select(KEY, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("__s").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("__e").alias("t")))).alias("x"))
        .select(KEY, F.col("x.kind").alias("__kind"), F.col("x.t").alias("__t"))
        .groupBy(KEY, "__kind", "__t")
        .agg(F.count("*").alias("__n"))
        .withColumn("__b", bucket_of(F.col("__t"), bucket_ms))
    )
    sizes = edge.groupBy(KEY, "__kind", "__b").agg(F.sum("__n").alias("__c"))
    before = Window.partitionBy(KEY, "__kind").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(KEY, "__kind", "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(KEY, "__kind", "__b").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        edge.withColumn("__i", F.sum("__n").over(inside))
        .join(offsets, [KEY, "__kind", "__b"])
        .withColumn("__upto", F.col("__o") + F.col("__i"))
    )
    ends = ranked.where("__kind = 1").select(KEY, F.col("__upto").alias("__r"), F.col("__t").alias("__gs"))
    starts = ranked.where("__kind = 0").select(KEY, (F.col("__upto") - F.col("__n")).alias("__r"), F.col("__t").alias("__ge"))
    gaps = ends.join(starts, [KEY, "__r"]).where("__ge > __gs").select(KEY, "__gs", "__ge")
    numbered = with_rank(gaps, "__gs", width=bucket_ms, out="__j")

    # period j ends where gap j begins and period j + 1 begins where it ends
    span = base.groupBy(KEY).agg(F.min("__s").alias("__first"), F.max("__e").alias("__last"))
    count = gaps.groupBy(KEY).agg(F.count("*").alias("__g"))
    none = F.lit(None).cast("long")
    borders = numbered.select(
        KEY,
        F.explode(F.array(F.struct(F.col("__j").alias("j"), none.alias("s"), F.col("__gs").alias("e")), F.struct((F.col("__j") + 1).alias("j"), F.col("__ge").alias("s"), none.alias("e")))).alias("x"),
    ).unionByName(
        span.join(count, KEY, "left").select(
            KEY,
            F.explode(F.array(F.struct(F.lit(0).cast("long").alias("j"), F.col("__first").alias("s"), none.alias("e")), F.struct(F.coalesce("__g", F.lit(0)).alias("j"), none.alias("s"), F.col("__last").alias("e")))).alias("x"),
        )
    )
    periods = borders.groupBy(KEY, F.col("x.j").alias("__j")).agg(F.max("x.s").alias("start_ms"), F.max("x.e").alias("end_ms"))
    out = periods.select(KEY, F.lit("period").alias("kind"), "start_ms", "end_ms").unionByName(
        gaps.select(KEY, F.lit("gap").alias("kind"), F.col("__gs").alias("start_ms"), F.col("__ge").alias("end_ms"))
    )
    return out.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], "kind", "start_ms", "end_ms")
