"""Name dictionaries of matches: variants to canonical names, and their types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T


def match_names(matches: DataFrame) -> DataFrame:
    """Names of every match, one row each: match_id, entity_type, canonical, seq (the order they are entered in)."""
    part = lambda c, kind, n: matches.select("match_id", F.lit(kind).alias("entity_type"), F.posexplode(c).alias("pos", "name"), F.lit(n).alias("n"))
    rows = (
        part(F.col("players"), "player", 0)
        .unionByName(part(F.col("referee"), "referee", 1))
        .unionByName(part(F.array("home", "away"), "team", 2))
        .unionByName(part(F.col("teams"), "team", 3))
        .unionByName(part(F.transform("venue", T.venue_name), "venue", 4))
    )
    return rows.where("name is not null").select("match_id", "entity_type", T.strip(F.col("name")).alias("canonical"), (F.col("n") * 100_000 + F.col("pos")).alias("seq")).where("canonical <> ''")


def build_gazetteer(names: DataFrame, learned: DataFrame | None = None, heard: DataFrame | None = None, least_seen: int = 2, least_confidence: float = 0.6) -> DataFrame:
    """[U4, F8, F9] match_id, variant, canonical.

    A name and its surname overwrite what was entered before (the last one
    counts); pairs and initials of long player names, further teams and
    learned spellings are taken only where nothing else is.  Learned spellings
    hold for every match; ``heard`` (match_id, variant) names those that occur
    in each, and only these are entered, so the list is never multiplied by the
    matches.
    """
    own = F.array(F.struct(F.col("canonical").alias("v"), F.lit(0).alias("k")))
    sur = F.when(F.col("entity_type").isin("player", "coach", "referee"), F.array(F.struct(T.surname(F.col("canonical")).alias("v"), F.lit(0).alias("k")))).otherwise(F.array().cast("array<struct<v:string,k:int>>"))
    pairs = F.when(F.col("entity_type") == "player", F.transform(T.name_variants(F.col("canonical")), lambda v: F.struct(v.alias("v"), F.lit(1).alias("k")))).otherwise(F.array().cast("array<struct<v:string,k:int>>"))
    rows = names.select("match_id", "canonical", "seq", F.posexplode(F.concat(own, sur, pairs)).alias("p", "x")).select("match_id", "canonical", "seq", "p", F.col("x.v").alias("variant"), F.col("x.k").alias("k")).where("variant <> ''")
    # overwriting entries: the last; filling ones: the first, after all others
    rank = F.when(F.col("k") == 0, F.struct(F.lit(1).alias("a"), F.col("seq").alias("b"), F.col("p").alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), (-F.col("seq")).alias("b"), (-F.col("p")).alias("c")))
    gaz = rows.groupBy("match_id", "variant").agg(F.max_by("canonical", rank).alias("canonical"))
    if learned is None:
        return gaz
    extra = learned.where((F.col("seen_count") >= least_seen) & (F.col("confidence") >= least_confidence) & (F.coalesce("correct", F.lit("")) != "")).select(F.col("misspelling").alias("variant"), F.col("correct").alias("canonical"))
    if heard is None:
        raise ValueError("learned spellings need the words heard in each match")
    found = heard.select("match_id", "variant").distinct().join(extra, "variant")
    return gaz.unionByName(found.join(gaz, ["match_id", "variant"], "left_anti").groupBy("match_id", "variant").agg(F.min("canonical").alias("canonical")))


def entity_types(names: DataFrame) -> DataFrame:
    """match_id, canonical, entity_type (the last one entered)."""
    return names.groupBy("match_id", "canonical").agg(F.max_by("entity_type", "seq").alias("entity_type"))


def team_words(types: DataFrame, least: int = 3) -> DataFrame:
    """[A23] match_id, word: lower-cased words of team and venue names."""
    return types.where(F.col("entity_type").isin("team", "venue")).select("match_id", F.explode(T.words(F.col("canonical"))).alias("w")).where(F.length("w") >= least).select("match_id", F.lower("w").alias("word")).distinct()


def first_names(types: DataFrame, least: int = 4) -> DataFrame:
    """[A22] match_id, first (lower case), canonicals: players and coaches by first name."""
    w = T.words(F.col("canonical"))
    rows = types.where(F.col("entity_type").isin("player", "coach") & (F.size(w) >= 2)).select("match_id", F.lower(F.get(w, F.lit(0))).alias("first"), "canonical")
    return rows.where(F.length("first") >= least).groupBy("match_id", "first").agg(F.sort_array(F.collect_set("canonical")).alias("canonicals"))


def prompt_names(names: DataFrame, cap: int = 40, header: str = "Names: ") -> DataFrame:
    """[U2, M5] match_id, hotwords, prompt: distinct names, teams first, comma-joined, at most ``cap``."""
    rank = F.when(F.col("entity_type") == "team", 0).when(F.col("entity_type") == "player", 1).otherwise(2)
    once = names.groupBy("match_id", "canonical").agg(F.min(F.struct(rank.alias("r"), "seq")).alias("o"))
    listed = once.groupBy("match_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("o", "canonical"))), 1, cap), lambda x: x["canonical"]).alias("l"))
    joined = F.array_join("l", ", ")
    return listed.select("match_id", joined.alias("hotwords"), F.concat(F.lit(header), joined).alias("prompt"))


def context_block(types: DataFrame, caps: Sequence[tuple[str, int]] = (("team", 8), ("player", 30), ("coach", 6), ("referee", 3), ("venue", 2))) -> DataFrame:
    """[T7, M5] match_id, context: capped lists of names by type, one line each."""
    w = Window.partitionBy("match_id", "entity_type").orderBy("canonical")
    cap = F.lit(0)
    for kind, n in caps:
        cap = F.when(F.col("entity_type") == kind, n).otherwise(cap)
    kept = types.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    order = F.lit(len(caps))
    for i, (kind, _) in enumerate(caps):
        order = F.when(F.col("entity_type") == kind, i).otherwise(order)
    lines = kept.groupBy("match_id", "entity_type").agg(F.array_join(F.sort_array(F.collect_list("canonical")), ", ").alias("l")).withColumn("o", order)
    return lines.groupBy("match_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", F.concat(F.initcap("entity_type"), F.lit("s: "), "l").alias("line")))), lambda x: x["line"]), "\n").alias("context"))
