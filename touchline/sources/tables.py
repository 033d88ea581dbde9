"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HALF = ("match_id", "feed", "half")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
