"""Pair records of two tables by nearest time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import KEY, entity, millis


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, start: str, end: str, tolerance_s: float = 1.5) -> DataFrame:
    """For each left row the right row of the same entity with the nearest midpoint.

    Midpoints are taken in half milliseconds and cut into buckets as wide as
    the tolerance; a right row is sent to its own and both adjacent buckets, so
    whatever lies within the tolerance meets in one (entity, bucket) group.
    There the two sides are joined in order: the nearest right midpoint not
    after and not before the left one, of which the nearer within tolerance is
    kept.  Only distinct midpoints of an entity meet, so a group has at most as
    many rows as the bucket has half milliseconds, however many records share
    them; left rows then look up what their midpoint found (a key of its own
    each; many rows at one are split by the skew join).

    Defined results: rows with a null id, start or end, or a time that is not
    finite, take no part; null keys match null keys; of equally near right rows
    the smallest id wins; repeated rows count once; an id that stands in two
    entities, or at two times, is a record of its own in each; a left row with
    nothing within ``tolerance_s`` (inclusive) gives no row; other columns are
    ignored.  Returns keys, left_id, right_id, diff_s.
    """
    width = int(round(tolerance_s * 2000))
    mid = millis(start) + millis(end)

    def side(df: DataFrame, rid: str) -> DataFrame:
        return df.select(entity(keys), mid.alias("__m"), F.col(rid).alias("__id")).where("__m is not null and __id is not null")

    b = F.floor(F.col("__m") / width)
    r = (
        side(right, right_id)
        .groupBy(KEY, "__m")
        .agg(F.min("__id").alias("__id"))
        .select(KEY, F.explode(F.array(b - 1, b, b + 1)).alias("__b"), "__m", F.lit(0).alias("__side"), F.col("__id").alias("__r"))
    )
    rows = side(left, left_id).distinct()
    lf = rows.select(KEY, "__m").distinct().select(KEY, b.alias("__b"), "__m", F.lit(1).alias("__side"), F.lit(None).alias("__r"))
    both = lf.unionByName(r).repartition(KEY, "__b")
    hit = F.when(F.col("__side") == 0, F.struct("__m", "__r"))
    up = Window.partitionBy(KEY, "__b").orderBy("__m", "__side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(KEY, "__b").orderBy(F.col("__m").desc(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    near = (
        both.withColumn("__p", F.last(hit, ignorenulls=True).over(up))
        .withColumn("__q", F.last(hit, ignorenulls=True).over(down))
        .where("__side = 1")
    )

    def cand(c: str):
        d = F.abs(F.col("__m") - F.col(f"{c}.__m"))
        return F.when(d <= width, F.struct(d.alias("d"), F.col(f"{c}.__r").alias("r")))

    best = near.withColumn("__best", F.least(cand("__p"), cand("__q"))).where("__best is not null").select(KEY, "__m", "__best")
    found = rows.join(best, [KEY, "__m"])
    return found.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.col("__id").alias(left_id), F.col("__best.r").alias(right_id), (F.col("__best.d") / 2000).alias("diff_s"))
