"""Queries of sources and sinks: what the tables hold, written as the files' JSON and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import evaluate as E
from touchline.plans.q_entity import CACHE, cache
from touchline.plans.q_eval import PAIRED, WIN, windowed
from touchline.plans.q_window import SEG, segments
from touchline.plans.registry import query
from touchline.session import shared_folder
from touchline.sources import json_files, sinks
from touchline.sources.tables import HALF, table

S_PATH = "match_id || '/' || feed || '/' || half"


def path():
    return F.concat_ws("/", "match_id", "feed", F.col("half").cast("string")).alias("path")


def transcript_files(spark, sf_dir, shape: str):
    """path, value: a JSON transcript per half, in the list or the object shape."""
    s = segments(spark, sf_dir)
    if shape == "list":
        number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
        one = F.concat(F.lit("["), number("start_time"), F.lit(","), number("end_time"), F.lit(","), _json_string("text"), F.lit("]"))
    else:
        one = F.to_json(F.struct("start_time", "end_time", "text", "avg_logprob", "no_speech_prob"))
    entry = F.concat(_json_string("segment_id"), F.lit(":"), one)
    halves = s.groupBy(*HALF).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]), ",").alias("b"))
    return halves.select(path(), F.concat(F.lit('{"segments":{'), "b", F.lit("}}")).alias("value"))


def _json_string(c):
    whole = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return whole.substr(F.lit(2), F.length(whole) - 2)


@query("ref_s2_list_segments", f"with {SEG} select {S_PATH} as path, segment_id, start_time, end_time, text from seg where text is not null union all select {S_PATH}, segment_id, start_time, end_time, null from seg where text is null")
def s2(spark, sf_dir):
    """[S2] Transcripts of lists: an id, then start, end and text."""
    return json_files.half_segments(transcript_files(spark, sf_dir, "list")).select("path", "segment_id", "start_time", "end_time", "text")


@query("ref_s3_object_segments", f"with {SEG} select {S_PATH} as path, segment_id, start_time, coalesce(end_time, 0.0) as end_time, coalesce(text, '') as text, avg_logprob, no_speech_prob from seg")
def s3(spark, sf_dir):
    """[S3, S7] Transcripts of objects: missing numbers are 0, missing texts empty."""
    return json_files.half_segments(transcript_files(spark, sf_dir, "object")).select("path", "segment_id", "start_time", "end_time", "text", "avg_logprob", "no_speech_prob")


@query("ref_s4_malformed", f"with {SEG} select {S_PATH} as path, count(*) as n from seg where half = 1 group by 1")
def s4(spark, sf_dir):
    """[S4] Broken files, and values of other shapes, are skipped: second halves lose their last brace, first halves get three values that are no segments."""
    files = transcript_files(spark, sf_dir, "list")
    broken = F.when(F.col("path").endswith("/2"), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.replace("value", F.lit('{"segments":{'), F.lit('{"segments":{"x1":[1.0,2.0],"x2":"text","x3":7,')))
    return json_files.half_segments(files.select("path", broken.alias("value"))).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "ref_s5_labels",
    """with m as (select match_id, unnest(players) nm, 'player' k from match_data union all select match_id, unnest(referee), 'referee' from match_data union all select match_id, unnest(venue), 'venue' from match_data
 union all select match_id, unnest(teams), 'team' from match_data union all select match_id, home, 'team' from match_data union all select match_id, away, 'team' from match_data)
select match_id as match_name, k as entity_type, nm as name, count(*) as n from m where nm <> '' group by all""",
)
def s5(spark, sf_dir):
    """[S5] Line-ups as one JSON value a match; a single referee is written as a string."""
    m = table(spark, sf_dir, "match_data")
    people = F.transform("players", lambda p: F.struct(p.alias("long_name"), F.lit(None).cast("string").alias("short_name")))
    lineup = F.struct(F.struct(people.alias("players")).alias("home"))
    alone = F.size("referee") == 1
    whole = F.to_json(F.struct(F.when(~alone, F.col("referee")).alias("referee"), F.array("home").alias("gameHomeTeam"), F.array("away").alias("gameAwayTeam"), "teams", "venue", lineup.alias("lineup")))
    one = F.concat(F.lit('{"referee":'), _json_string(F.get("referee", F.lit(0))), F.lit(","), F.substring(whole, F.lit(2), F.length(whole)))
    files = m.select(F.concat(F.lit("root/league/season/"), F.url_encode("match_id"), F.lit("/Labels-caption.json")).alias("path"), F.when(alone, one).otherwise(whole).alias("value"))
    return json_files.label_names(files).groupBy("match_name", "entity_type", "name").agg(F.count("*").alias("n"))


@query("ref_s6_ground_truth", f"with r as (select distinct on (ref_id) * from timed_ref) select {S_PATH} as path, start_sec as start, start_sec + (end_sec - start_sec) as end, coalesce(text, '') as text from r")
def s6(spark, sf_dir):
    """[S6] Ground truth as lists of offset, duration and commentary."""
    r = table(spark, sf_dir, "timed_ref").dropDuplicates(["ref_id"])
    item = F.struct(F.col("ref_id").alias("i"), F.col("start_sec").alias("offset"), (F.col("end_sec") - F.col("start_sec")).alias("duration"), F.col("text").alias("commentary"))
    files = r.groupBy(*HALF).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value")).select(path(), "value")
    return json_files.ground_truth_rows(files)


@query("ref_s9_cache_round_trip", f"with {CACHE} select mishearing, correct, array_to_string(matches_seen, '|') as matches_seen, round(fuzzy_avg, 6) as fuzzy_avg from cache")
def s9(spark, sf_dir):
    """[K2, S9] The validated cache as one JSON document, read back."""
    document = sinks.dictionary_document(cache(spark, sf_dir), "mishearing")
    rows = json_files.dictionary_rows(document, json_files.VALIDATED, "mishearing")
    return rows.select("mishearing", "correct", F.array_join("matches_seen", "|").alias("matches_seen"), F.round("fuzzy_avg", 6).alias("fuzzy_avg"))


@query(
    "ref_s8_learned_round_trip",
    "with c as (select distinct on (correction_id) * from corrections where stage = 'entity' and original <> '' and corrected <> '' and score is not null and not isnan(score)) select lower(original) as misspelling, arg_min(corrected, correction_id) as correct, count(*) as seen_count, round(avg(score), 6) as fuzzy_score_avg from c group by 1",
)
def s8(spark, sf_dir):
    """[K3, S8] Learned spellings as one JSON document, read back."""
    c = table(spark, sf_dir, "corrections").where("stage = 'entity' and original <> '' and corrected <> '' and score is not null and not isnan(score)").dropDuplicates(["correction_id"])
    rows = c.groupBy(F.lower("original").alias("misspelling")).agg(F.min_by("corrected", "correction_id").alias("correct"), F.lit(0.9).alias("confidence"), F.count("*").alias("seen_count"), F.avg("score").alias("fuzzy_score_avg"))
    back = json_files.dictionary_rows(sinks.dictionary_document(rows, "misspelling"), json_files.LEARNED, "misspelling")
    return back.select("misspelling", "correct", "seen_count", F.round("fuzzy_score_avg", 6).alias("fuzzy_score_avg"))


@query(
    "ref_k1_round_trip",
    f"""with {SEG}, c as (select match_id, feed, half, count(*) n from (select distinct on (correction_id) * from corrections) group by all),
o as (select match_id, feed, half, count(*) n from seg group by all)
select match_id, feed, half, segment_id, match_id || '__h' || half || '__s' || segment_id as global_id, start_time, coalesce(end_time, 0.0) as end_time, coalesce(text, '') as text, o.n as original, coalesce(c.n, 0) as corrections from seg join o using (match_id, feed, half) left join c using (match_id, feed, half)""",
)
def k1_back(spark, sf_dir):
    """[K1] The cleaned layout of all segments with their corrections, written and taken apart again."""
    s = segments(spark, sf_dir)
    c = table(spark, sf_dir, "corrections").dropDuplicates(["correction_id"])
    documents = sinks.cleaned_documents(s, c, None, s).select(*HALF, path(), "value")
    rows = json_files.half_segments(documents.select("path", "value"))
    ids = F.map_entries(F.from_json(F.get_json_object("value", "$.segments"), "map<string, struct<global_id:string>>"))
    each = documents.select("path", F.explode(ids).alias("e")).select("path", F.col("e.key").alias("segment_id"), F.col("e.value.global_id").alias("global_id"))
    meta = documents.select(
        *HALF, "path", F.get_json_object("value", "$.cleaning_metadata.original_segment_count").cast("long").alias("original"),
        F.coalesce(F.size(F.from_json(F.get_json_object("value", "$.cleaning_metadata.corrections"), "array<string>")), F.lit(0)).cast("long").alias("corrections"),
    )
    counted = meta.withColumn("corrections", F.greatest("corrections", F.lit(0).cast("long")))
    return rows.join(each, ["path", "segment_id"]).join(counted, "path").select(*HALF, "segment_id", "global_id", "start_time", "end_time", "text", "original", "corrections")


def s_even(c: str) -> str:
    """A time in whole milliseconds to two places, half to even."""
    ms = f"round({c} * 1000)::bigint"
    return f"({ms} // 10 + case when {ms} % 10 > 5 or ({ms} % 10 = 5 and ({ms} // 10) % 2 = 1) then 1 else 0 end) / 100.0"


@query("ref_k4_round_trip", f"with {SEG} select match_id, feed, half, segment_id, {s_even('start_time')} as start_time, {s_even('end_time')} as end_time, text from seg")
def k4_back(spark, sf_dir):
    """[K4, S7] The search export, its blocks read as transcripts again."""
    blocks = sinks.export_blocks(segments(spark, sf_dir)).select("match_id", "feed", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(Part \d+\n\n\{.*?\}\})(?=\n\nPart |$)"), 1)).alias("b"))
    files = blocks.select(F.concat_ws("/", "match_id", "feed", F.regexp_extract("b", r"^Part (\d+)", 1)).alias("path"), F.regexp_replace("b", r"^Part \d+\n\n", "").alias("value"))
    p = F.split("path", "/")
    return json_files.half_segments(files).select(F.get(p, F.lit(0)).alias("match_id"), F.get(p, F.lit(1)).alias("feed"), F.get(p, F.lit(2)).cast("int").alias("half"), "segment_id", "start_time", "end_time", "text")


@query("ref_k6_csv_round_trip", "select correction_id, original, corrected, method from (select distinct on (correction_id) * from corrections) where original is not null and corrected is not null and method is not null")
def k6(spark, sf_dir):
    """[K6] A report as CSV files in the shared folder, read back."""
    c = table(spark, sf_dir, "corrections").dropDuplicates(["correction_id"]).where("original is not null and corrected is not null and method is not null").select("correction_id", "original", "corrected", "method")
    folder = shared_folder(spark, "report")
    sinks.write_csv(c, folder)
    return spark.read.option("header", True).option("nullValue", "\\N").option("escape", "\\").schema("correction_id long, original string, corrected string, method string").csv(folder)


@query("ref_k8_evaluation_document", f"with {WIN}, {PAIRED} select match_id, feed, half, sum(n)::bigint as ref_words, sum(x)::bigint as errors, round(sum(x)::double / sum(n), 6) as wer from e group by all")
def k8(spark, sf_dir):
    """[K8] Evaluation rows as one JSON document, read back."""
    rows = E.pairwise_wer(windowed(spark, sf_dir), HALF, "ref_text", "hyp_text").select(*HALF, "ref_words", (F.col("substitutions") + F.col("insertions") + F.col("deletions")).alias("errors"), F.round("wer", 6).alias("wer"))
    document = sinks.evaluation_document(rows, list(HALF), "all", "stock", 0.75)
    back = F.from_json(F.get_json_object("value", "$.rows"), "array<struct<match_id:string,feed:string,half:int,ref_words:bigint,errors:bigint,wer:double>>")
    return document.select(F.explode(back).alias("r")).select("r.*")


@query(
    "ref_s11_first_answer",
    "with a as (select match_id, home as name from match_data where league is not null), b as (select match_id, away as name from match_data) select match_id, name, 'service' as source from a union all select match_id, name, 'fallback' from b where match_id not in (select match_id from a)",
)
def s11(spark, sf_dir):
    """[S11] Names by an injected service, which fails for matches without a league; those take the fallback's."""
    m = table(spark, sf_dir, "match_data")
    answers = json_files.fetched(m.select(F.concat_ws("|", "match_id", "home", F.coalesce("league", F.lit("?"))).alias("key")), "key", _service, tries=2, wait_s=0.0)
    named = json_files.lineup_from_api(answers.where("value is not null"), "value").select(F.split("name", r"\|").alias("p"))
    service = named.select(F.get("p", F.lit(0)).alias("match_id"), F.get("p", F.lit(1)).alias("name"), F.lit("service").alias("source"))
    fallback = m.select("match_id", F.col("away").alias("name"), F.lit("fallback").alias("source"))
    return json_files.first_answer(m, [service, fallback], "match_id")


def _service(key: str) -> str | None:
    import json

    match, home, league = key.split("|")
    if league == "?":
        raise OSError("no answer")
    return json.dumps({"homeTeam": {"name": f"{match}|{home}"}})
