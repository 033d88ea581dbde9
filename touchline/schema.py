"""Column types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as t

WORD = t.StructType([t.StructField("word", t.StringType()), t.StructField("start", t.DoubleType()), t.StructField("end", t.DoubleType()), t.StructField("prob", t.DoubleType())])

SEGMENTS = t.StructType([
    t.StructField("league", t.StringType()), t.StructField("season", t.StringType()), t.StructField("match_name", t.StringType()), t.StructField("half", t.IntegerType()),
    t.StructField("segment_id", t.StringType()), t.StructField("ord", t.LongType()), t.StructField("start_time", t.DoubleType()), t.StructField("end_time", t.DoubleType()),
    t.StructField("text", t.StringType()), t.StructField("words", t.ArrayType(WORD)), t.StructField("avg_logprob", t.DoubleType()), t.StructField("no_speech_prob", t.DoubleType()),
    t.StructField("frozen_word_indices", t.ArrayType(t.IntegerType())),
])

CACHE = t.StructType([
    t.StructField("mishearing", t.StringType()), t.StructField("correct", t.StringType()), t.StructField("matches_seen", t.ArrayType(t.StringType())),
    t.StructField("fuzzy_avg", t.DoubleType()), t.StructField("last_updated", t.DateType()),
])

LEARNED = t.StructType([
    t.StructField("misspelling", t.StringType()), t.StructField("correct", t.StringType()), t.StructField("confidence", t.DoubleType()),
    t.StructField("seen_count", t.LongType()), t.StructField("fuzzy_score_avg", t.DoubleType()),
])
