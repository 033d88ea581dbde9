"""JSON files of transcripts, line-ups, ground truth and dictionaries.

Each file is one value whose shape varies, so files are read whole as text and
taken apart with ``parse_json`` / VARIANT; nothing is inferred, and a value of
another shape is skipped, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import schema


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, value of the files below ``root`` whose names match; none is no error."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True)
    return reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value"))


def _number(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "double") for p in paths])


def half_segments(files: DataFrame, start: tuple[str, ...] = ("$.start", "$.start_time"), end: tuple[str, ...] = ("$.end", "$.end_time")) -> DataFrame:
    """[S2, S3, S4, S7] path, segment_id, pos, start_time, end_time, text, words, avg_logprob, no_speech_prob.

    ``segments`` maps ids to [start, end, text] or to objects; missing numbers
    are 0.0, missing texts ''; shorter lists and other values are left out.
    """
    parsed = files.select("path", F.try_parse_json("value").alias("v")).where("v is not null")
    listed = parsed.select("path", F.try_variant_get("v", "$.segments", "variant").alias("s")).where("s is not null")
    each = listed.lateralJoin(listed.sparkSession.tvf.variant_explode(F.col("s").outer())).select("path", F.col("pos"), F.col("key").alias("segment_id"), F.col("value").alias("x"))
    kind = F.schema_of_variant("x")
    as_list = kind.startswith("ARRAY") & F.try_variant_get("x", "$[2]", "variant").isNotNull()
    as_object = kind.startswith("OBJECT")
    words = F.from_json(F.to_json(F.try_variant_get("x", "$.words", "variant")), f"array<{schema.WORD.simpleString()}>")
    return each.where(as_list | as_object).select(
        "path", "segment_id", F.col("pos").cast("long").alias("pos"),
        F.when(as_list, _number(F.col("x"), "$[0]")).otherwise(F.coalesce(_number(F.col("x"), *start), F.lit(0.0))).alias("start_time"),
        F.when(as_list, _number(F.col("x"), "$[1]")).otherwise(F.coalesce(_number(F.col("x"), *end), F.lit(0.0))).alias("end_time"),
        F.when(as_list, F.try_variant_get("x", "$[2]", "string")).otherwise(F.coalesce(F.try_variant_get("x", "$.text", "string"), F.lit(""))).alias("text"),
        F.when(as_object, words).alias("words"),
        F.when(as_object, _number(F.col("x"), "$.avg_logprob")).alias("avg_logprob"), F.when(as_object, _number(F.col("x"), "$.no_speech_prob")).alias("no_speech_prob"),
    )


def discover(spark: SparkSession, root: str, variant: str = "") -> DataFrame:
    """[S1, S13, U1, T1] Segments of all matches below root/league/season/match.

    Both layouts are read (files in commentary_data/ or beside it).  Files of
    the variant come first, stock ones if a match has none; then the folder
    layout decides.  A match with neither half gives no rows.  ``ord`` is the
    order by half, start and position in the file.
    """
    files = whole_files(spark, root, f"[12]_asr{variant}.json")
    if variant:
        files = files.unionByName(whole_files(spark, root, "[12]_asr.json"))
    p = F.regexp_replace(F.url_decode("path"), r"^.*?://", "")
    parts = F.regexp_extract(p, r"([^/]+)/([^/]+)/([^/]+?)(/commentary_data)?/([12])_asr([^/]*)\.json$", 0)
    g = lambda n: F.regexp_extract(p, r"([^/]+)/([^/]+)/([^/]+?)(/commentary_data)?/([12])_asr([^/]*)\.json$", n)
    named = files.where(parts != "").select("path", "value", g(1).alias("league"), g(2).alias("season"), g(3).alias("match_name"), g(5).cast("int").alias("half"), F.when(g(6) == variant, 0).otherwise(2).alias("a"), F.when(g(4) != "", 0).otherwise(1).alias("b"))
    # a match takes both halves from one place
    best = Window.partitionBy("league", "season", "match_name")
    chosen = named.withColumn("rank", F.col("a") + F.col("b")).withColumn("least", F.min("rank").over(best)).where("rank = least")
    rows = half_segments(chosen.select("path", "value")).join(chosen.select("path", "league", "season", "match_name", "half"), "path")
    order = Window.partitionBy("league", "season", "match_name").orderBy("half", "start_time", "pos")
    out = rows.withColumn("ord", F.row_number().over(order).cast("long") - 1).withColumn("frozen_word_indices", F.lit(None).cast("array<int>"))
    return out.select(*schema.SEGMENTS.names)


def match_filter(df: DataFrame, part: str) -> DataFrame:
    """[S10] Matches whose name has ``part``, case aside."""
    return df.where(F.contains(F.lower("match_name"), F.lit(part.lower())))


def labels(spark: SparkSession, root: str) -> DataFrame:
    """[S5] The names of the line-up files below ``root``, as ``label_names`` gives them."""
    return label_names(whole_files(spark, root, "Labels-caption.json"))


def label_names(files: DataFrame) -> DataFrame:
    """[S5] path, league, season, match_name, seq, entity_type, name, alternatives: the names in line-up files (path, value).

    Strings and lists, strings and objects are both accepted for teams,
    referees and venues.  Broken files give nothing.
    """
    files = files.select("path", F.try_parse_json("value").alias("v")).where("v is not null")
    p = F.regexp_replace(F.url_decode("path"), r"^.*?://", "")
    g = lambda n: F.regexp_extract(p, r"([^/]+)/([^/]+)/([^/]+)/Labels-caption\.json$", n)
    person = "array<struct<long_name:string,short_name:string,name:string>>"
    get = lambda path, kind: F.from_json(F.to_json(F.try_variant_get("v", path, "variant")), kind)

    def strings(path: str) -> Column:
        one = F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.array(F.try_variant_get("v", path, "string")))
        return F.coalesce(one, get(path, "array<string>"), F.array().cast("array<string>"))

    def people(path: str, kind: str) -> Column:
        return F.transform(F.coalesce(get(path, person), F.array().cast(person)), lambda x: F.struct(F.lit(kind).alias("entity_type"), F.coalesce(F.nullif(x["long_name"], F.lit("")), x["short_name"]).alias("name"), F.array(x["short_name"], x["name"]).alias("alternatives")))

    def named(c: Column, kind: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("name"), F.array(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("alternatives")))

    def side(path: str) -> Column:
        text = F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string"))
        name = F.coalesce(text, F.try_variant_get("v", f"{path}.name", "string"))
        other = F.coalesce(get(f"{path}.names", "array<string>"), F.array().cast("array<string>"))
        return F.array(F.struct(F.lit("team").alias("entity_type"), name.alias("name"), other.alias("alternatives")))

    referees = F.when(F.try_variant_get("v", "$.referee_matched", "variant").isNotNull(), strings("$.referee_matched")).otherwise(strings("$.referee"))
    every = F.concat(
        people("$.lineup.home.players", "player"), people("$.lineup.home.coach", "coach"), people("$.lineup.away.players", "player"), people("$.lineup.away.coach", "coach"),
        named(referees, "referee"), named(F.concat(strings("$.gameHomeTeam"), strings("$.gameAwayTeam")), "team"), side("$.home"), side("$.away"), named(strings("$.teams"), "team"), named(strings("$.venue"), "venue"),
    )
    return files.select("path", g(1).alias("league"), g(2).alias("season"), g(3).alias("match_name"), F.posexplode(every).alias("seq", "x")).where("x.name is not null and x.name <> ''").select("path", "league", "season", "match_name", "seq", "x.entity_type", "x.name", "x.alternatives")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """[S6] start, end, text from a list of {offset, duration, commentary}, or from either transcript shape; by start."""
    return ground_truth_rows(spark.read.option("wholetext", True).text(path).select(F.lit(path).alias("path"), "value")).drop("path").orderBy("start")


def ground_truth_rows(files: DataFrame) -> DataFrame:
    """[S6] path, start, end, text of the files (path, value)."""
    v = files.select("path", "value", F.try_parse_json("value").alias("v"))
    listed = v.where(F.schema_of_variant("v").startswith("ARRAY"))
    rows = listed.select("path", F.explode(F.from_json("value", "array<struct<offset:double,duration:double,commentary:string>>")).alias("x")).select("path", F.col("x.offset").alias("start"), (F.col("x.offset") + F.col("x.duration")).alias("end"), F.coalesce("x.commentary", F.lit("")).alias("text"))
    others = half_segments(v.where(~F.schema_of_variant("v").startswith("ARRAY")).select("path", "value")).select("path", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "text")
    return rows.unionByName(others)


# The fields of the dictionary files' entries.
LEARNED = "correct:string,confidence:double,seen_count:bigint,fuzzy_score_avg:double"
VALIDATED = "correct:string,matches_seen:array<string>,fuzzy_avg:double,last_updated:date"


def dictionary_rows(files: DataFrame, fields: str, key: str) -> DataFrame:
    """[S8, S9] The entries of JSON objects of objects (value) as rows; broken ones have none."""
    entries = F.map_entries(F.from_json("value", f"map<string, struct<{fields}>>"))
    return files.select(F.explode(entries).alias("e")).select(F.col("e.key").alias(key), "e.value.*")


def _dictionary(spark: SparkSession, path: str, fields: str, key: str) -> DataFrame:
    """A missing or empty file has no rows."""
    try:
        files = spark.read.option("wholetext", True).text(path)
    except Exception:  # noqa: BLE001
        files = spark.createDataFrame([], "value string")
    return dictionary_rows(files, fields, key)


def learned(spark: SparkSession, path: str) -> DataFrame:
    """[S8] misspelling, correct, confidence, seen_count, fuzzy_score_avg"""
    return _dictionary(spark, path, LEARNED, "misspelling")


def validated_cache(spark: SparkSession, path: str) -> DataFrame:
    """[S9] mishearing, correct, matches_seen, fuzzy_avg, last_updated"""
    return _dictionary(spark, path, VALIDATED, "mishearing")


def lineup_from_api(responses: DataFrame, value: str) -> DataFrame:
    """[S11] The mapping of a line-up service's match JSON to names: entity_type, name (the call itself is not made here)."""
    v = responses.select(F.try_parse_json(value).alias("v")).where("v is not null")
    get = lambda path, kind: F.from_json(F.to_json(F.try_variant_get("v", path, "variant")), kind)
    people = lambda path, kind: F.transform(F.coalesce(get(path, "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), lambda x: F.struct(F.lit(kind).alias("entity_type"), x["name"].alias("name")))
    one = lambda path, kind: F.array(F.struct(F.lit(kind).alias("entity_type"), F.try_variant_get("v", path, "string").alias("name")))
    every = F.concat(one("$.homeTeam.name", "team"), one("$.awayTeam.name", "team"), people("$.homeTeam.lineup", "player"), people("$.awayTeam.lineup", "player"), one("$.homeTeam.coach.name", "coach"), one("$.awayTeam.coach.name", "coach"), people("$.referees", "referee"), one("$.venue", "venue"))
    return v.select(F.explode(every).alias("x")).select("x.*").where("name is not null and name <> ''")


def date_window(day: Column, days: int = 1) -> Column:
    """[S11] The dates a match is looked for on."""
    return F.struct(F.date_sub(day, days).alias("first"), F.date_add(day, days).alias("last"))


def first_answer(wanted: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """[S11] For each wanted key the rows of the first source that has any: a service's answer, else the fallbacks in order."""
    left, out = wanted.select(key).distinct(), None
    for rows in sources:
        found = rows.join(left, key, "left_semi")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        left = left.join(found.select(key).distinct(), key, "left_anti")
    return out


def fetched(wanted: DataFrame, key: str, fetch: Callable[[str], str | None], tries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """[S11] key, value: what an injected call gives for each key; a call that raises is tried again, ``wait_s`` doubling, then value is null."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for k in pdf[key]:
                value = None
                for n in range(tries):
                    try:
                        value = fetch(k)
                        break
                    except Exception:  # noqa: BLE001
                        if n + 1 < tries:
                            time.sleep(wait_s * 2**n)
                values.append(value)
            yield pd.DataFrame({key: pdf[key], "value": values})

    kind = wanted.schema[key].dataType.simpleString()
    return wanted.select(key).distinct().mapInPandas(run, f"{key} {kind}, value string")


def transcribed(audio: DataFrame, path: str, model) -> DataFrame:
    """[S12] Segments of audio files by an injected model: path, segment_id, start_time, end_time, text.

    ``model`` gets a path and gives (start, end, text) tuples; empty texts are
    dropped and ids count from 0.  It is made once per task.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf[path]:
                said = [(s, e, t.strip()) for s, e, t in model(p) if t and t.strip()]
                rows += [(p, str(i), float(s), float(e), t) for i, (s, e, t) in enumerate(said)]
            yield pd.DataFrame(rows, columns=["path", "segment_id", "start_time", "end_time", "text"])

    return audio.select(path).mapInPandas(run, "path string, segment_id string, start_time double, end_time double, text string")
