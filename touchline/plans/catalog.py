"""Queries of the core operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.operators.intervals import periods_and_gaps
from touchline.plans import q_entity, q_eval, q_report, q_sources, q_stream, q_text, q_window  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES, query
from touchline.sources.tables import HALF, table

def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean every transcript and summarise each match."""
    return QUERIES["ref_a14_summary"](spark, sf_dir)


@query(
    "p5_found",
    """
with v as (
  select match_id, feed, half, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e
  from segments where end_time is not null and end_time > start_time),
m as (
  select *, max(e) over (partition by match_id, feed, half order by s, e rows between unbounded preceding and 1 preceding) pe from v),
g as (
  select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by match_id, feed, half order by s, e rows unbounded preceding) grp from m),
p as (select match_id, feed, half, grp, min(s) s, max(e) e from g group by all),
n as (select *, lead(s) over (partition by match_id, feed, half order by grp) nxt from p)
select match_id, feed, half, 'period' as kind, s as start_ms, e as end_ms from n
union all
select match_id, feed, half, 'gap', e, nxt from n where nxt is not null
""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: unbroken periods of commentary and the gaps between them."""
    return periods_and_gaps(table(spark, sf_dir, "segments"), HALF, "start_time", "end_time")
