"""Summaries of a run."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T

STAGES = ("normalization", "spell_check", "grammar", "entity", "neural", "llm")


def stage_breakdown(corrections: DataFrame) -> DataFrame:
    """[A15] stage, n for every stage there is, and a total."""
    n = corrections.groupBy("stage").agg(F.count("*").alias("n"))
    every = corrections.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    rows = every.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.unionByName(rows.agg(F.lit("total").alias("stage"), F.sum("n").alias("n")))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """[A16, A6] The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def timed(stages: Sequence[tuple[str, Callable[[], DataFrame]]]) -> dict[str, float]:
    """[A25] Wall seconds of each stage, its plan run to the end without keeping rows, and the total."""
    out: dict[str, float] = {}
    for name, stage in stages:
        began = time.time()
        stage().write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - began, 3)
    return out | {"total": round(sum(out.values()), 3)}


def report_text(totals: DataFrame, breakdown: DataFrame, corrections: DataFrame, removed: DataFrame, per_band: int = 1000, examples: int = 15) -> str:
    """[K7, K10] The text report: totals, stages, corrections by band, examples (bounded as given)."""
    t = totals.agg(*[F.sum(c).alias(c) for c in ("original", "kept", "hallucinations", "duplicates")], F.count("*").alias("matches")).first()
    lines = ["CLEANING REPORT", f"matches {t['matches']}, segments {t['original']}, kept {t['kept']}, hallucinations {t['hallucinations']}, duplicates {t['duplicates']}"]
    if t["original"]:
        lines.append(f"retention {t['kept'] / t['original'] * 100:.1f} %")
    lines.append("CORRECTIONS BY STAGE")
    lines += [f"  {r['stage']:<16}{r['n']:>8}" for r in breakdown.collect()]
    banded = corrections.withColumn("band", T.confidence_band(F.col("score")))
    w = Window.partitionBy("band").orderBy(F.desc("score"), "original", "corrected")
    lines.append("CORRECTIONS BY CONFIDENCE")
    for r in banded.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_band).orderBy("band", "n").select("band", "score", "original", "corrected", "method").limit(3 * per_band).collect():
        lines.append(f"  [{r['band']}] {r['score']:.1f} {r['original']} -> {r['corrected']} ({r['method']})")
    lines.append("REMOVED, EXAMPLES")
    lines += [f"  [{r['reason']}] {r['text']}" for r in removed.orderBy("reason", "text").limit(examples).collect()]
    return "\n".join(lines)


def walkthrough(timings: DataFrame, diffs: DataFrame, samples: DataFrame, most: int = 8) -> str:
    """[K9] Stage timings by half (stage, half, seconds), changed texts (original, text), distinct corrections (original, corrected)."""
    pivot = timings.groupBy("stage").pivot("half", [1, 2]).agg(F.sum("seconds")).orderBy("stage").collect()
    lines = ["| stage | half 1 | half 2 |", "| --- | --- | --- |", *[f"| {r[0]} | {r[1] or 0:.3f} | {r[2] or 0:.3f} |" for r in pivot], "", "Changed texts:"]
    lines += [f"- {r[0]} => {r[1]}" for r in diffs.select("original", "text").limit(most).collect()]
    return "\n".join([*lines, "", "Corrections:", *[f"- {r[0]} => {r[1]}" for r in samples.select("original", "corrected").limit(most).collect()]])
