"""The cleaning of transcripts as one plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import folds
from touchline.session import cut_lineage

HALF = ("match_id", "feed", "half")
MATCH = ("match_id", "feed")


ROW = (*HALF, "segment_id")


def classified(segments: DataFrame, language: str, detect: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """[P5] Adds reason: hallucination_repeated_name_segment first, then the filter's, null where a row stays.

    Rows are told by match_id, feed, half and segment_id, nulls being equal to nulls.
    """
    row = F.struct(*ROW).alias("__row")
    stuck = folds.stuck_names(segments, MATCH, ("half", "segment_id"), "start_time", "text").select(row, F.lit(True).alias("__stuck")).distinct()
    df = segments.select("*", row).join(stuck, "__row", "left")
    if detect is None:
        reason = T.removal_reason(F.col("text"))
    else:
        # the detector, a Python function, sees only what is long enough to be judged
        long = df.where(F.size(T.words(F.col("text"))) >= 15).select("__row", F.pandas_udf(lambda s: detect(s), "string")("text").alias("__lang")).dropDuplicates(["__row"])
        df = df.join(long, "__row", "left")
        reason = T.removal_reason(F.col("text"), F.col("__lang"), F.col(language))
    return df.withColumn("reason", F.when(F.col("__stuck"), "hallucination_repeated_name_segment").otherwise(reason)).drop("__stuck", "__lang", "__row")


def staged(segments: DataFrame, language: str = "language", detect: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Every row of ``segments`` once, with what became of it: kept, reason, duplicate_of, similarity.

    ``reason`` is the filter's, or 'duplicate' for rows merged into another;
    end_time is that of the merged row.  The frame is written down, so what
    reads it several times computes nothing twice.
    """
    marked = cut_lineage(classified(segments, language, detect))
    columns = [c for c in segments.columns if c not in (*ROW, "end_time")]
    merged = folds.merge_near_duplicates(marked.where("reason is null"), HALF, "segment_id", "start_time", "end_time", "ord", "text", carry=columns)
    out = [*ROW, "end_time", *columns, "kept", F.when(~F.col("kept"), "duplicate").alias("reason"), "duplicate_of", "similarity"]
    filtered = marked.where("reason is not null").select(*ROW, "end_time", *columns, F.lit(False).alias("kept"), "reason", F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("double").alias("similarity"))
    return cut_lineage(merged.select(*out).unionByName(filtered))


def clean(segments: DataFrame, language: str = "language", detect: Callable[[pd.Series], pd.Series] | None = None, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The deterministic stages: filter, merge, collapse, normalise.

    segments: match_id, feed, half, segment_id, ord, start_time, end_time,
    text, words and a language column.  Returns the cleaned rows (text,
    end_time and words as they are then) and the removed ones (reason or
    duplicate_of and similarity, text cut to 80 characters).  ``rows`` are
    those of ``staged``, if they are there already.
    """
    rows = staged(segments, language, detect) if rows is None else rows
    out = rows.where("kept").withColumn("__c", T.collapse_repeats(F.col("text"))).withColumn("__n", T.normalise(F.col("__c"), F.col(language)))
    changed = (F.col("__n") != F.col("text")) | (F.col("__c") != F.col("text"))
    cleaned = out.withColumn("words", F.when(~changed, F.col("words"))).withColumn("text", F.col("__n")).drop("__c", "__n", "kept", "reason", "duplicate_of", "similarity")
    removed = rows.where("not kept").select(*ROW, "start_time", F.substring("text", 1, 80).alias("text"), "reason", "duplicate_of", "similarity")
    return cleaned, removed


def summary(rows: DataFrame) -> DataFrame:
    """[A14] One row a match of ``staged``: counts of original, kept, hallucinated and repeated rows, and the share kept."""
    repeated = F.col("reason") == "duplicate"
    out = rows.groupBy(*MATCH).agg(
        F.count("*").alias("original"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept") & ~repeated).alias("hallucinations"), F.count_if(~F.col("kept") & repeated).alias("duplicates"),
    )
    return out.withColumn("retention", F.bround(F.col("kept") / F.col("original") * 100, 1))
