"""Draw records by source so that sizes meet target shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.tokenize import TOKENIZER, token_counts
from touchline.session import cut_lineage


def source_name(c: Column) -> Column:
    """Sources are told apart without case, outer spaces, and '-' or ' ' for '_'."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def _cumulative(rate: float, cap: int) -> np.ndarray:
    """P(N <= k) for k < cap, N a Poisson variable; computed by logarithms, so for any rate."""
    k = np.arange(cap, dtype=float)
    logs = k * np.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def poisson_steps(mean: float, cap: int) -> list[float]:
    """P(N <= k) for k < cap, N a Poisson variable cut at ``cap`` with that mean.

    The Poisson rate is the one whose cut variable has the mean; a mean of
    ``cap`` (or more) needs an infinite one, so all steps are 0.  Steps at the
    end that no number below 1 reaches are left out.
    """
    if cap <= 0 or mean <= 0:
        return [1.0] * min(max(cap, 0), 1)
    if mean >= cap * (1 - 1e-9):
        return [0.0] * cap
    # the mean of the cut variable is the sum of P(N > k) over k < cap
    low, high = 0.0, 1.0
    while (1 - _cumulative(high, cap)).sum() < mean:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - _cumulative(mid, cap)).sum() < mean else (low, mid)
    steps = _cumulative(high, cap)
    return steps[: int(np.searchsorted(steps, 1.0)) + 1].tolist()


def mix_sources(
    df: DataFrame, targets: DataFrame, row_id: str, source: str, text: str, total_tokens: int | None = None, seed: int = 7,
    tokenizer: str = TOKENIZER, corrections: int = 2, most_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """The drawn copies, and the shares reached.

    A source's mean repetition rate is share * total / its tokens.  A row's
    seeded hash is its number u in [0, 1); the Poisson distribution with the
    source's mean, cut at max_repeats, is inverted at u and gives the copies,
    whatever the other rows draw.  Copies are exploded and shuffled globally by
    a hash of id and copy.

    Drawn tokens miss the target by chance, most in small sources.  So the
    means are corrected ``corrections`` times by target / drawn and the same
    numbers are inverted anew; what then remains shows in the report.

    ``total_tokens`` defaults to the largest total at which every source with
    rows can still meet its share; a source that can't is used max_repeats
    times and shows in the report.

    Defined results: rows with null ids, without tokens (null or empty texts),
    or of no listed source are never drawn (the last aren't even encoded); rows
    with equal id count once; targets with a null source, share or max_repeats,
    or none positive, draw nothing; targets written alike after ``source_name``
    are added up, with the smaller max_repeats; a listed source without rows
    has actual share 0; extra columns are ignored.  The targets reach the
    driver and are refused above ``most_sources``.

    Returns (row_id, copy_no, source, n_tokens, shuffle_key) in shuffled order
    and (source, target_share, actual_share, max_repeats, rows_available,
    tokens_available, mean_repeats, rows_used, copies, tokens_used).
    """
    spark = df.sparkSession
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source is not null and target_share is not null and max_repeats is not null")
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    ).limit(most_sources + 1).collect()
    if len(wanted) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    everything = spark.createDataFrame([(w["source"], float(w["target_share"]), int(w["max_repeats"])) for w in wanted], "source string, target_share double, max_repeats int")
    names = (
        df.select(F.col(row_id).cast("long").alias("row_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
        .where("row_id is not null").join(F.broadcast(everything.select("source")), "source")
    )
    sized = token_counts(names, "row_id", "text", tokenizer, keep=("source",)).where("n_tokens > 0")
    sized = sized.groupBy("row_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("row_id", "x.*")
    u = F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    sized = cut_lineage(sized.withColumn("u", u))
    have = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    live = {w["source"]: (float(w["target_share"]), int(w["max_repeats"])) for w in wanted if w["source"] in have and w["target_share"] > 0 and w["max_repeats"] > 0}
    total = float(total_tokens) if total_tokens is not None else min((cap * have[s][1] / share for s, (share, cap) in live.items()), default=0.0)
    wish = {s: min(share * total / have[s][1], float(cap)) for s, (share, cap) in live.items()}

    def draw(means: dict[str, float]) -> DataFrame:
        steps = spark.createDataFrame([(s, poisson_steps(m, live[s][1])) for s, m in means.items()], "source string, steps array<double>")
        return sized.join(F.broadcast(steps), "source").select("row_id", "source", "n_tokens", F.size(F.filter("steps", lambda s: F.col("u") >= s)).alias("copies"))

    means = dict(wish)
    for _ in range(corrections if live else 0):
        got = {r["source"]: r["t"] for r in draw(means).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
        means = {s: min(m * wish[s] * have[s][1] / got[s], float(live[s][1])) if got.get(s) else m for s, m in means.items()}
    counted = cut_lineage(draw(means))
    drawn = (
        counted.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row_id", "copy_no", "source", "n_tokens", F.xxhash64("row_id", "copy_no", F.lit(seed + 1)).alias("shuffle_key"))
        .orderBy("shuffle_key", "row_id", "copy_no")
    )
    used = counted.groupBy("source").agg(
        F.count("*").alias("rows_available"), F.sum("n_tokens").alias("tokens_available"), F.count_if(F.col("copies") > 0).alias("rows_used"),
        F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"),
    )
    asked = spark.createDataFrame([(s, m) for s, m in wish.items()], "source string, mean_repeats double")
    joined = everything.join(used, "source", "left").join(asked, "source", "left")
    tokens = used.agg(F.sum("tokens_used").alias("sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = joined.join(F.broadcast(tokens)).select(
        "source", "target_share", F.coalesce(F.col("tokens_used") / F.nullif("sum", F.lit(0)), F.lit(0.0)).alias("actual_share"), "max_repeats",
        zero("rows_available"), zero("tokens_available"), F.coalesce("mean_repeats", F.lit(0.0)).alias("mean_repeats"), zero("rows_used"), zero("copies"), zero("tokens_used"),
    )
    return drawn, report
