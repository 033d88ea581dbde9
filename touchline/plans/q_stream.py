"""Queries of the streaming operators: the segments read as a stream, run until all that is there is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans.q_report import S_REASON
from touchline.plans.q_window import S_LONE
from touchline.plans.registry import query, s_words
from touchline.session import shared_folder
from touchline.sources.tables import HALF, table
from touchline.streaming import windows


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments as a stream of files in the shared folder, with the time they were spoken at (kick-off at 2020-01-01)."""
    whole, folder = table(spark, sf_dir, "segments"), shared_folder(spark, "arriving")
    whole.write.parquet(folder)
    rows = spark.readStream.schema(whole.schema).parquet(folder)
    return rows.withColumn("kickoff", F.lit("2020-01-01 00:00:00").cast("timestamp")).withColumn("at", windows.event_time("start_time"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream gives for the data there is, written to the shared folder and read back."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "ref_stream_chunks",
    "select match_id, feed, half, k * 8000::bigint as start_ms, count(*) as n, max(end_time) as end_time from segments, lateral (select unnest(range(floor((round(start_time * 1000) - 12000) / 8000)::bigint + 1, floor(round(start_time * 1000) / 8000)::bigint + 1)) k) where start_time is not null group by all",
)
def chunks(spark, sf_dir):
    """[W6, streaming] Counts of sliding chunks of the segments as they arrive, redelivered ones as well."""
    out = drained(windows.chunk_counts(arriving(spark, sf_dir), list(HALF), "at"), "complete")
    start = F.unix_millis("window.start") - F.unix_millis(F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return out.select(*HALF, start.alias("start_ms"), "n", "end_time")


@query("ref_stream_once", "select distinct match_id, feed, half, segment_id from segments")
def once_each(spark, sf_dir):
    """Redelivered segments dropped on the way."""
    return drained(windows.once_per_segment(arriving(spark, sf_dir), [*HALF, "segment_id"], "at"), "append").select(*HALF, "segment_id")


@query("ref_stream_kept", f"select seg_key, ord from segments where ({S_REASON}) is null")
def kept(spark, sf_dir):
    """[P3, streaming] The filter on a stream."""
    return drained(windows.kept_segments(arriving(spark, sf_dir)), "append").select("seg_key", "ord")


@query(
    "ref_stream_bursts",
    f"""with a as (select match_id, feed, half, round(start_time * 1000)::bigint t, lower(x) token from (select *, {S_LONE} x from segments where text is not null) where len({s_words('x')}) = 1 and regexp_matches(x, '^\\p{{Lu}}') and regexp_matches(x, '\\p{{Ll}}') and start_time is not null),
g as (select *, case when t - lag(t) over w > 60000 then 1 else 0 end new from a window w as (partition by match_id, feed, half, token order by t)),
i as (select *, sum(new) over (partition by match_id, feed, half, token order by t) i from g)
select match_id, feed, half, token, min(t) as start_ms, count(*) as n from i group by match_id, feed, half, token, i having count(*) >= 3""",
)
def bursts(spark, sf_dir):
    """[W2, streaming relative] Sessions of one single-word name."""
    out = drained(windows.name_bursts(arriving(spark, sf_dir), list(HALF), "at"), "complete")
    start = F.unix_millis("session_window.start") - F.unix_millis(F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return out.select(*HALF, "token", start.alias("start_ms"), "n")
