"""Joins of time intervals and alignments of two timed tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from touchline.operators.ordered import KEY, entity, fold_groups, plain_key, with_last_flag, with_rank, with_running_max


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, start: str, end: str, least_s: float | None = None, bucket_s: float = 16.0) -> DataFrame:
    """[J5, J6] Pairs whose spans overlap: by ``least_s`` or more, or (None) strictly.

    Both sides are laid into time buckets and joined on entity and bucket; a
    pair counts in the bucket of its later start only, so it comes out once.
    Returns keys, left_id, right_id, overlap_s.  Null or inverted spans never overlap.
    """

    def laid(df: DataFrame, rid: str, p: str) -> DataFrame:
        b = F.sequence(F.floor(F.col(start) / bucket_s), F.floor(F.col(end) / bucket_s))
        return df.where((F.col(end) >= F.col(start)) & F.col(rid).isNotNull()).select(entity(keys), F.explode(b).alias("__b"), F.col(rid).alias(rid), F.col(start).alias(f"{p}s"), F.col(end).alias(f"{p}e"))

    pair = laid(left, left_id, "__l").join(laid(right, right_id, "__r"), [KEY, "__b"])
    late = F.greatest("__ls", "__rs")
    over = F.least("__le", "__re") - late
    hit = (over >= least_s) if least_s is not None else (over > 0)
    return plain_key(pair.where(hit & (F.floor(late / bucket_s) == F.col("__b"))), keys, [left_id, right_id, over.alias("overlap_s")])


def windows(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], ref_id: str, hyp_id: str, start: str, end: str, text: str, least_s: float | None = 0.25) -> DataFrame:
    """[J5, J6] Every reference row with the texts of all hypotheses over it, in order; n_hyp may be 0."""
    pairs = overlap_join(reference, hypothesis, keys, ref_id, hyp_id, start, end, least_s)
    texts = pairs.join(hypothesis.select(hyp_id, F.col(start).alias("__s"), F.coalesce(text, F.lit("")).alias("__t")), hyp_id)
    joined = texts.groupBy(ref_id).agg(F.count("*").alias("n_hyp"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__s", hyp_id, "__t"))), lambda x: x["__t"]), " ").alias("hyp_text"))
    return reference.select(*keys, ref_id, F.coalesce(text, F.lit("")).alias("ref_text")).join(joined, ref_id, "left").select(*keys, ref_id, "ref_text", F.coalesce("n_hyp", F.lit(0)).alias("n_hyp"), F.coalesce("hyp_text", F.lit("")).alias("hyp_text"))


def with_fallback(rows: DataFrame, second: DataFrame, row_id: str, text: str, n: str) -> DataFrame:
    """[J15] Rows with ``n`` = 0 take the text of ``second`` (by row_id, one row each), else ''; adds ref_only."""
    other = second.select(row_id, F.col(text).alias("__second"))
    filled = F.when(F.col(n) > 0, F.col(text)).otherwise(F.coalesce("__second", F.lit("")))
    return rows.join(other, row_id, "left").withColumn(text, filled).withColumn("ref_only", F.col(n) == 0).drop("__second")


def uncovered(right: DataFrame, left: DataFrame, keys: Sequence[str], right_id: str, left_id: str, start: str, end: str, least_s: float | None = None) -> DataFrame:
    """[J9] Rows of ``right`` that overlap no row of ``left``."""
    return right.join(overlap_join(left, right, keys, left_id, right_id, start, end, least_s), right_id, "left_anti")


def _both(reference: DataFrame, hypothesis: DataFrame, keys, ref_id, hyp_id, start, end, tolerance: float) -> DataFrame:
    """Both sides in order of time, cut where no pair can cross.  Ids stay numbers if they are on both sides, else they are strings."""
    kind = "long" if all(isinstance(df.schema[rid].dataType, IntegralType) for df, rid in ((reference, ref_id), (hypothesis, hyp_id))) else "string"
    side = lambda df, rid, n: df.where(F.col(start).isNotNull() & F.col(rid).isNotNull()).select(entity(keys), F.lit(n).alias("__side"), F.col(rid).cast(kind).alias("__id"), F.col(start).alias("__s"), F.coalesce(end, start).alias("__e"))
    rows = side(reference, ref_id, 0).unionByName(side(hypothesis, hyp_id, 1)).withColumn("__t", F.round(F.col("__s") * 1000).cast("long"))
    ranked = with_running_max(with_rank(rows, "__t", ["__side", "__id"]), F.greatest("__s", "__e"), "__reach", before=True)
    island = with_last_flag(ranked, F.coalesce(F.col("__s") > F.col("__reach") + tolerance, F.lit(True)), "__island")
    return island.withColumn("__kid", F.to_json(KEY))


def _greedy(rows: DataFrame, keys, ref_id, hyp_id, merge) -> DataFrame:
    """keys, ref_id, hyp_id: the pairs (ref, hyp) that ``merge`` makes of each stretch's sides, lists of (id, start, end)."""
    schema = rows.select(KEY).schema[KEY].dataType.simpleString()
    kind = rows.schema["__id"].dataType.simpleString()

    def walk(stretch: list[tuple]) -> Iterator[tuple]:
        sides = [[(i, s, e) for _, _, side, i, s, e, _ in stretch if side == n] for n in (0, 1)]
        return ((stretch[0][0], ref, hyp) for ref, hyp in merge(*sides))

    pairs = fold_groups(rows.select("__kid", "__island", "__side", "__id", "__s", "__e", "__rank"), ["__kid", "__island"], ["__rank"], walk, [("__kid", "string"), ("ref", kind), ("hyp", kind)])
    back = pairs.withColumn(KEY, F.from_json("__kid", schema))
    return plain_key(back, keys, [F.col("ref").alias(ref_id), F.col("hyp").alias(hyp_id)])


def merge_by_time(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], ref_id: str, hyp_id: str, start: str, end: str, tolerance: float = 0.75) -> DataFrame:
    """[J7] One-to-one walk over both sides: keys, ref_id, hyp_id, either null where a row stays alone.

    The two heads pair if their midpoints are within ``tolerance`` or their
    spans overlap; else the reference steps on if it ends before the other
    begins, else the hypothesis.  A walk, so Python; but it is cut where
    nothing can pair across, and each stretch is walked by itself.  Rows
    without a start are left out, a null end is read as the start.
    """

    def merge(r: list[tuple], h: list[tuple]) -> list[tuple]:
        i, j, out = 0, 0, []
        while i < len(r) or j < len(h):
            if j >= len(h):
                out.append((r[i][0], None))
                i += 1
            elif i >= len(r):
                out.append((None, h[j][0]))
                j += 1
            else:
                (a, s, e), (b, t, f) = r[i], h[j]
                if abs((s + e) - (t + f)) <= 2 * tolerance or (s < f and t < e):
                    out.append((a, b))
                    i, j = i + 1, j + 1
                elif e <= t:
                    out.append((a, None))
                    i += 1
                else:
                    out.append((None, b))
                    j += 1
        return out

    return _greedy(_both(reference, hypothesis, keys, ref_id, hyp_id, start, end, tolerance), keys, ref_id, hyp_id, merge)


def take_nearest(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], ref_id: str, hyp_id: str, start: str, end: str, tolerance: float = 0.75) -> DataFrame:
    """[J8] Each reference in order takes the free hypothesis with the nearest midpoint, no farther than tolerance + half its length.

    Returns keys, ref_id, hyp_id (null if none was left).  Ties go to the earlier hypothesis.
    """

    def merge(r: list[tuple], h: list[tuple]) -> list[tuple]:
        free, out = dict(enumerate(h)), []
        low = 0
        longest = max((f - t for _, t, f in h), default=0.0)
        for a, s, e in r:
            mid, best, dist = (s + e) / 2, None, float("inf")
            while low < len(h) and h[low][2] < s - longest - 2 * tolerance - (e - s):
                low += 1
            for k in range(low, len(h)):
                if h[k][1] > mid + tolerance:
                    break  # its span begins too late, and so do all after it
                if k in free:
                    d = abs(mid - (h[k][1] + h[k][2]) / 2)
                    if d < dist and d <= tolerance + (h[k][2] - h[k][1]) / 2:
                        best, dist = k, d
            out.append((a, free.pop(best)[0] if best is not None else None))
        return out

    return _greedy(_both(reference, hypothesis, keys, ref_id, hyp_id, start, end, tolerance), keys, ref_id, hyp_id, merge)
