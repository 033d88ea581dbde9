"""Streaming forms of the batch operators, for segments that arrive as they are spoken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T


def event_time(start: str, kickoff: str = "kickoff"):
    """Seconds into a half as a timestamp, from the half's kick-off time."""
    return F.timestamp_micros((F.unix_micros(F.col(kickoff)) + F.round(F.col(start) * 1e6).cast("long")))


def chunk_counts(stream: DataFrame, keys: list[str], at: str, late: str = "30 seconds", size: str = "12 seconds", slide: str = "8 seconds") -> DataFrame:
    """[W6] Counts and texts of sliding chunks; a chunk is final once the watermark has passed its end."""
    return stream.withWatermark(at, late).groupBy(*keys, F.window(at, size, slide)).agg(F.count("*").alias("n"), F.max("end_time").alias("end_time"))


def once_per_segment(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Redelivered segments dropped within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def kept_segments(stream: DataFrame, text: str = "text") -> DataFrame:
    """[P3] The stateless filter and normalisation on a stream."""
    return stream.where(T.removal_reason(F.col(text)).isNull()).withColumn(text, T.squeeze_space(T.squeeze_punct(T.drop_disfluencies(F.col(text)))))


def name_bursts(stream: DataFrame, keys: list[str], at: str, text: str = "text", gap: str = "60 seconds", late: str = "2 minutes", least: int = 3) -> DataFrame:
    """[W2, streaming relative] Sessions of one single-word name no farther apart than ``gap``.

    Sessions grow from their last row, clusters of the batch operator from
    their first; a session holds all rows of its clusters.
    """
    from touchline.operators.folds import lone_name

    named = stream.withColumn("token", lone_name(F.col(text))).where("token is not null").withWatermark(at, late)
    return named.groupBy(*keys, "token", F.session_window(at, gap)).agg(F.count("*").alias("n")).where(F.col("n") >= least)
