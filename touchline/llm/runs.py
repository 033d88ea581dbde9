"""Runs of successive events that say the same, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.utterance import numbers, utterance_key
from touchline.operators.ordered import KEY, entity, millis, with_previous, with_rank
from touchline.session import cut_lineage


def same_utterance(a: Column, b: Column, slips: int = 4) -> Column:
    """Whether two structs (key, digits) give one utterance.

    Numbers must agree exactly; the rest may differ in ``slips`` letters, fewer
    for short texts (one in five letters), since a name or a word more differs
    in more.  Equal keys agree in any case, also when they are empty.
    """
    d = F.levenshtein(a["key"], b["key"], slips)
    short = F.least(F.length(a["key"]), F.length(b["key"]))
    close = (d >= 0) & (d <= F.ceil(short / 5))
    return (a["digits"] == b["digits"]) & ((a["key"] == b["key"]) | close)


def repeated_runs(df: DataFrame, keys: Sequence[str], row_id: str, start: str, end: str, tie: str, text: str, slips: int = 4) -> DataFrame:
    """Each longest run of two or more successive events that say the same.

    Events are ordered by start, tie, id inside each entity; null or blank
    texts are skipped.  An event that agrees with its predecessor points to
    it.  Then every pointer is replaced by its target's pointer until all lead
    to an event that points nowhere, the start of the run; that takes log2 of
    the longest run rounds.  Pointers of one round have distinct targets, as
    finished rows leave the join, so a run of any length makes no hot key.

    Returns keys, first_id, last_id, n_events, start_ms, end_ms (the latest
    known end, or start, of the run) and duration_ms.

    Defined results: rows with a null id are left out; rows that share entity
    and id count once (the smallest by start and text stays); null starts come
    first; null ends are read as the start; null keys are an entity; no runs
    give an empty result; other columns are ignored.
    """
    src = df.select(
        entity(keys), F.col(row_id).alias("__id"), millis(start).alias("__t"), F.col(tie).alias("__tie"),
        F.coalesce(millis(end), millis(start)).alias("__e"), F.col(text).alias("__x"),
    ).where(r"__id is not null and __x rlike '(?U)\\S'")
    once = (
        src.select(KEY, "__id", F.struct("__t", "__tie", "__e", F.struct(utterance_key(F.col("__x")).alias("key"), numbers(F.col("__x")).alias("digits")).alias("say")).alias("__row"))
        .groupBy(KEY, "__id").agg(F.min("__row").alias("__row"))
        .select(KEY, "__id", "__row.*")
    )
    ranked = with_rank(once, "__t", ["__tie", "__id"])
    me = F.struct(F.col("__id").alias("id"), F.col("__t").alias("t"), F.col("__e").alias("e"), F.col("say").alias("say"))
    pairs = with_previous(ranked, me, "__prev").where(F.col("__prev").isNotNull())
    linked = pairs.where(same_utterance(F.col("__prev.say"), F.col("say"), slips)).select(
        KEY, "__rank", "__id", "__e",
        (F.col("__rank") - 1).alias("to"),
        F.struct(F.col("__prev.id").alias("id"), F.col("__prev.t").alias("t"), F.col("__prev.e").alias("e")).alias("root"),
    )
    links = cut_lineage(linked)
    point = links.select(KEY, "__rank", "to", "root")
    done = None
    while True:
        target = point if done is None else point.unionByName(done)
        target = target.select(KEY, F.col("__rank").alias("to"), F.col("to").alias("__to2"), F.col("root").alias("__root2"), F.lit(True).alias("__hit"))
        moved = cut_lineage(
            point.join(target, [KEY, "to"], "left").select(
                KEY, "__rank", F.coalesce("__to2", "to").alias("to"), F.when(F.col("__hit"), F.col("__root2")).otherwise(F.col("root")).alias("root"), F.col("__hit").isNotNull().alias("__more")
            )
        )
        ended = moved.where("not __more").drop("__more")
        done = ended if done is None else done.unionByName(ended)
        point = moved.where("__more").drop("__more")
        if point.isEmpty():
            break
    run = (
        links.drop("to", "root").join(done, [KEY, "__rank"])
        .groupBy(KEY, F.col("to").alias("__start"))
        .agg(
            F.first("root").alias("root"), F.max_by("__id", "__rank").alias("last_id"),
            (F.count("*") + 1).alias("n_events"), F.max("__e").alias("__end"),
        )
    )
    end_ms = F.greatest("__end", F.col("root.e"))
    return run.select(
        *[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.col("root.id").alias("first_id"), "last_id", "n_events",
        F.col("root.t").alias("start_ms"), end_ms.alias("end_ms"), (end_ms - F.col("root.t")).alias("duration_ms"),
    )
