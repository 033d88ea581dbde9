"""Queries of the training-data operators, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.canonical import map_to_list
from touchline.llm.langid import document_languages, fit_languages, score_texts
from touchline.llm.mixing import mix_sources
from touchline.llm.nearest import nearest_in_time
from touchline.llm.repetition import repetition
from touchline.llm.runs import repeated_runs
from touchline.llm.textquality import text_types
from touchline.llm.tokenize import token_ids
from touchline.llm.turns import speaker_turns, turn_texts
from touchline.llm.utterance import FILLERS, FOLD_FROM, FOLD_TO
from touchline.llm.vocabulary import learn_vocabulary
from touchline.plans.registry import s_strip
from touchline.sources.tables import HALF, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: names freely written in three columns to rows of the gazetteer."""
    corrections, entities = table(spark, sf_dir, "corrections"), table(spark, sf_dir, "entities")
    fields = [(corrections, "corrections", "correction_id", "original"), (corrections, "corrections", "correction_id", "corrected"), (entities, "entities", "entity_id", "text")]
    values = None
    for df, name, row_id, column in fields:
        part = df.select(F.lit(f"{name}.{column}").alias("field_name"), F.col(row_id).alias("row_id"), F.col(column).alias("value"))
        values = part if values is None else values.unionByName(part)
    return map_to_list(values, table(spark, sf_dir, "gazetteer"), ["field_name", "row_id"], "value").select("field_name", "row_id", "ref_id")


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: turns of one known speaker each."""
    return speaker_turns(
        table(spark, sf_dir, "raw_segments"), table(spark, sf_dir, "speakers"), HALF, "segment_id", "start_time", "text"
    ).select(*HALF, "speaker_id", F.col("first_id").alias("first_segment_id"), F.col("last_id").alias("last_segment_id"))


@query("p2_turns")
def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: the clean text of the turns."""
    return turn_texts(table(spark, sf_dir, "raw_segments"), table(spark, sf_dir, "speakers"), HALF, "segment_id", "start_time", "text")


@query(
    "p3_found",
    """
with r as (select distinct ref_id, match_id, feed, half, cast(round(start_sec * 1000) as bigint) + cast(round(end_sec * 1000) as bigint) m from timed_ref where end_sec is not null),
h as (select distinct hyp_id, match_id, feed, half, cast(round(start_sec * 1000) as bigint) + cast(round(end_sec * 1000) as bigint) m from timed_hyp where end_sec is not null),
j as (select ref_id, hyp_id, row_number() over (partition by ref_id order by abs(r.m - h.m), hyp_id) n
      from r join h on r.match_id = h.match_id and r.feed = h.feed and r.half = h.half and abs(r.m - h.m) <= 3000)
select ref_id, hyp_id from j where n = 1
""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: the recogniser row nearest in time to each reference row."""
    return nearest_in_time(
        table(spark, sf_dir, "timed_ref"), table(spark, sf_dir, "timed_hyp"), HALF, "ref_id", "hyp_id", "start_sec", "end_sec", 1.5
    ).select("ref_id", "hyp_id")


def s_folded(x: str) -> str:
    return f"regexp_replace(replace(replace(replace(translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '\\p{{M}}+', '', 'g')"


def s_utterance(x: str) -> str:
    """The key of an utterance, of CTE columns: letters stretched and words stammered count once, no fillers and spaces."""
    spoken = f"trim(regexp_replace(' ' || regexp_replace({s_folded(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ((?:{'|'.join(FILLERS)}) )+', ' ', 'g'))"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        spoken = f"regexp_replace({spoken}, '{letter}{{2,}}', '{letter}', 'g')"
    return spoken


@query(
    "p4_found",
    f"""with s as (select distinct on (match_id, feed, half, segment_id) * from segments where {s_strip('text')} <> ''),
u as (select match_id, feed, half, segment_id, start_time, ord, string_split({s_utterance('text')}, ' ') w, array_to_string(regexp_extract_all(text, '(\\p{{Nd}}+)', 1), ' ') digits from s),
k as (select * exclude (w), array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 or w[i] <> w[i - 1] or not regexp_full_match(w[i], '\\p{{L}}+')), lambda i: w[i]), '') as key from u),
o as (select *, row_number() over (partition by match_id, feed, half order by round(start_time * 1000) nulls first, ord nulls first, segment_id) rn from k),
p as (select *, lag(key) over q pk, lag(digits) over q pd from o window q as (partition by match_id, feed, half order by rn)),
g as (select *, case when pk is not null and digits = pd and (key = pk or (levenshtein(key, pk) <= 4 and levenshtein(key, pk) <= ceil(least(length(key), length(pk)) / 5.0))) then 0 else 1 end new from p),
i as (select *, sum(new) over (partition by match_id, feed, half order by rn) i from g)
select match_id, feed, half, arg_min(segment_id, rn) as first_segment_id, arg_max(segment_id, rn) as last_segment_id from i group by match_id, feed, half, i having count(*) >= 2""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: runs of successive segments that give one utterance."""
    return repeated_runs(table(spark, sf_dir, "segments"), HALF, "segment_id", "start_time", "end_time", "ord", "text").select(
        *HALF, F.col("first_id").alias("first_segment_id"), F.col("last_id").alias("last_segment_id")
    )


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: languages of documents wrongly labelled, of mixed documents' paragraphs, of segments foreign to their league."""
    documents, segments, leagues = (table(spark, sf_dir, t) for t in ("documents", "segments", "leagues"))
    vocabulary = learn_vocabulary(documents, "text")
    model = fit_languages(documents, "doc_id", "text", "lang", vocabulary=vocabulary)
    parts = document_languages(documents, "doc_id", "text", "lang", model, vocabulary).where("prose and doc_lang is not null")
    wrong = parts.where("part_no = 1 and (label_code is null or label_code <> doc_lang)").select(
        F.lit("document").alias("grain"), "row_id", F.lit(0).alias("part_no"), F.col("doc_lang").alias("lang"))
    mixed = parts.where("doc_langs > 1").select(F.lit("paragraph").alias("grain"), "row_id", "part_no", "lang")
    spoken = segments.select("seg_key", "league", "text").where(F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")) >= 8)
    scored = score_texts(spoken, ["seg_key", "league"], "text", model).where("lang is not null")
    expected = leagues.select("league", F.col("lang").alias("expected"))
    foreign = scored.join(expected, "league", "left").where("expected is null or expected <> lang").select(
        F.lit("segment").alias("grain"), F.col("seg_key").alias("row_id"), F.lit(0).alias("part_no"), "lang").distinct()
    return wrong.unionByName(mixed).unionByName(foreign)


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: prose documents and segments that repeat more than two fifths of their words."""
    documents, segments = table(spark, sf_dir, "documents"), table(spark, sf_dir, "segments")
    of_documents = repetition(documents, "doc_id", "text", learn_vocabulary(documents, "text")).where("prose")
    found = of_documents.select(F.lit("document").alias("grain"), "row_id", "share").unionByName(
        repetition(segments, "seg_key", "text").select(F.lit("segment").alias("grain"), "row_id", "share")
    )
    return found.where("share > 0.4").select("grain", "row_id").distinct()


@query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the measured share of every document and segment."""
    documents, segments = table(spark, sf_dir, "documents"), table(spark, sf_dir, "segments")
    part = lambda df, grain, key: repetition(df, key, "text").select(F.lit(grain).alias("grain"), "row_id", "words", "repeated_words", "share", "char_share")
    return part(documents, "document", "doc_id").unionByName(part(segments, "segment", "seg_key")).distinct()


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: token ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: the drawn copies of documents, in shuffled order."""
    drawn, _ = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text")
    return drawn.withColumnRenamed("row_id", "doc_id")


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: target and actual share of each source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text")[1]


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: documents that are mostly not prose, with their kind."""
    kinds = text_types(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kinds.where("kind <> 'prose'").select(F.col("row_id").alias("doc_id"), "kind")


@query("p10_stats")
def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: the statistics themselves with the type and its confidence."""
    return text_types(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")
