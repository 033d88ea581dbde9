"""Queries of counts, reports, search, guards and the whole cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import guards, names, report, search
from touchline.operators.ordered import millis, whole_order
from touchline.plans import clean as C
from touchline.plans.q_text import S_NONLATIN, S_RATIO, S_W3, s_normal, s_restored
from touchline.plans.q_window import FOLD, HEARD, MASKED, S_KEY, SEG, STUCK, segments, with_language
from touchline.plans.registry import query, s_strip, s_words
from touchline.sources import json_files, sinks
from touchline.sources.tables import HALF, table

MATCH = ("match_id", "feed")
ONCE = "c as (select distinct on (correction_id) * from corrections)"


def once(spark, sf_dir):
    return table(spark, sf_dir, "corrections").dropDuplicates(["correction_id"])


@query("ref_s10_match_filter", f"with {SEG} select match_id, count(*) as n from seg where contains(lower(match_name), 'united') group by 1")
def s10(spark, sf_dir):
    return json_files.match_filter(segments(spark, sf_dir), "United").groupBy("match_id").agg(F.count("*").alias("n"))


@query("ref_u1_halves", f"with {SEG} select match_id, feed, count(*) as n, count(distinct half) as halves from seg group by all")
def u1(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.where("half = 1").unionByName(s.where("half = 2")).groupBy(*MATCH).agg(F.count("*").alias("n"), F.countDistinct("half").alias("halves"))


@query(
    "ref_u3_sets",
    f"with {ONCE}, a as (select distinct match_id, lower(original) x from c where original is not null), b as (select distinct match_id, lower(corrected) x from c where corrected is not null) select match_id, x, 'both' as side from (select * from a intersect select * from b) union all select match_id, x, 'original' from (select * from a except select * from b)",
)
def u3(spark, sf_dir):
    c = once(spark, sf_dir)
    a = c.where("original is not null").select("match_id", F.lower("original").alias("x"))
    b = c.where("corrected is not null").select("match_id", F.lower("corrected").alias("x"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.distinct().join(b.distinct(), ["match_id", "x"], "left_anti").withColumn("side", F.lit("original")))


@query("ref_a4_counts", "select source, label, count(*) as n from (select distinct on (entity_id) * from entities) group by all")
def a4(spark, sf_dir):
    return table(spark, sf_dir, "entities").dropDuplicates(["entity_id"]).groupBy("source", "label").agg(F.count("*").alias("n"))


@query("ref_a5_distinct_names", "select match_id, count(distinct lower(text)) as n from entities group by 1")
def a5(spark, sf_dir):
    return table(spark, sf_dir, "entities").groupBy("match_id").agg(F.countDistinct(F.lower("text")).alias("n"))


@query("ref_a6_first_occurrence", "select entity_id, row_number() over (partition by match_id, lower(text) order by entity_id) > 1 as is_dup_in_match from (select distinct on (entity_id) * from entities where text is not null)")
def a6(spark, sf_dir):
    e = table(spark, sf_dir, "entities").where("text is not null").dropDuplicates(["entity_id"])
    return e.select("entity_id", (F.row_number().over(Window.partitionBy("match_id", F.lower("text")).orderBy("entity_id")) > 1).alias("is_dup_in_match"))


@query("ref_a15_stage_breakdown", f"with {ONCE}, s as (select unnest(['normalization', 'spell_check', 'grammar', 'entity', 'neural', 'llm']) stage), n as (select stage, count(*) n from c group by 1), r as (select s.stage, coalesce(n, 0) n from s left join n using (stage)) select * from r union all select 'total', sum(n)::bigint from r")
def a15(spark, sf_dir):
    return report.stage_breakdown(once(spark, sf_dir))


@query("ref_a16_distinct_corrections", f"with {ONCE} select match_id, correction_id from (select *, row_number() over (partition by match_id, segment_id, original, corrected order by correction_id) n from c) where n = 1")
def a16(spark, sf_dir):
    return report.first_of(once(spark, sf_dir), ["match_id", "segment_id", "original", "corrected"], ["correction_id"]).select("match_id", "correction_id")


@query("ref_a26_correction_sample", f"with {ONCE}, d as (select match_id, original, corrected, min(correction_id) i from c where original is not null and corrected is not null group by all), r as (select *, row_number() over (partition by match_id order by i) n from d) select match_id, original, corrected from r where n <= 8")
def a26(spark, sf_dir):
    d = report.first_of(once(spark, sf_dir).where("original is not null and corrected is not null"), ["match_id", "original", "corrected"], ["correction_id"])
    w = Window.partitionBy("match_id").orderBy("correction_id")
    return d.withColumn("n", F.row_number().over(w)).where("n <= 8").select("match_id", "original", "corrected")


@query(
    "ref_a20_majority",
    f"with {ONCE}, v as (select match_id, judge_choice v, count(*) n, min(correction_id) o from c where judge_choice is not null group by all), t as (select match_id, sum(n) s, arg_max(v, n * 1000000000 - o) v, max(n) m from v group by 1) select distinct c.match_id, case when t.v is null then null when 2 * m > s then t.v else 'D' end as choice from c left join t using (match_id)",
)
def a20(spark, sf_dir):
    return guards.majority(once(spark, sf_dir), ["match_id"], "judge_choice", "correction_id")


@query("ref_a21_joined_text", f"with {SEG} select match_id, feed, string_agg(text, ' ' order by half, ord, segment_id) as text from seg where text is not null group by all")
def a21(spark, sf_dir):
    listed = segments(spark, sf_dir).where("text is not null").groupBy(*MATCH).agg(F.sort_array(F.collect_list(F.struct("half", "ord", "segment_id", "text"))).alias("x"))
    return listed.select(*MATCH, F.array_join(F.transform("x", lambda v: v["text"]), " ").alias("text"))


@query("ref_j14_registry", f"with {SEG} select seg_key, coalesce(m.match_name, seg.match_id) as match_name, coalesce(m.home, '') as home, coalesce(m.played_on::varchar, '') as played_on from seg left join match_data m using (match_id)")
def j14(spark, sf_dir):
    """Every segment with its match's name and facts, as the registry has them."""
    s = segments(spark, sf_dir).select("seg_key", "match_id")
    return names.with_registry(s, table(spark, sf_dir, "match_data"), "match_id", "match_name", ["home", "played_on"]).select("seg_key", "match_name", "home", "played_on")


@query("ref_k5_registry_upsert", "select league, country, lang from leagues where lang <> 'en' union all select league, 'new', lang from leagues where lang = 'en' union all select 'added', 'new', 'en'")
def k5(spark, sf_dir):
    old = table(spark, sf_dir, "leagues")
    new = old.where("lang = 'en'").withColumn("country", F.lit("new")).unionByName(spark.createDataFrame([("added", "new", "en")], old.schema))
    return sinks.upsert(old, new, "league")


S_REASON = f"case when {s_strip('coalesce(text, chr(32))')} = '' then 'empty_segment' when {S_NONLATIN} then 'non_latin_characters' when {S_RATIO} < 0.5 then 'low_alpha_ratio' end"


CLASSED = f"{SEG}, {STUCK}, cls as (select seg.*, case when st.segment_id is not null then 'hallucination_repeated_name_segment' else {S_REASON} end as reason from seg left join (select distinct match_id, feed, half, segment_id from stuck) st using (match_id, feed, half, segment_id))"


@query("ref_p5_classified", f"with recursive {CLASSED} select seg_key, reason from cls")
def p5(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("language", F.lit("en"))
    return C.classified(s, "language").select("seg_key", F.regexp_replace("reason", r" \(.*", "").alias("reason"))


S_PLAIN = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda v: v <> '')"


def s_detected(texts: str, ids: str) -> str:
    """CTEs up to ``dt`` (ids, detected) over ``texts`` (ids, text)."""
    return f"""lw as (select lang as language, word, count(*) n from (select lang, unnest({S_PLAIN.format('text')}) word from seg join leagues using (league) where text is not null) group by all),
kn as (select distinct word from lw), sz as (select language, ln(sum(n) + (select count(*) from kn)) sz from lw group by 1),
tw as (select {ids}, word, count(*) k from (select {ids}, unnest({S_PLAIN.format('text')}) word from {texts}) where word in (select word from kn) group by all),
gn as (select {ids}, language, sum(k * ln(n + 1)) g from tw join lw using (word) group by all), sd as (select {ids}, sum(k) k from tw group by all),
sc as (select sd.*, sz.language, coalesce(g, 0) - k * sz s from sd cross join sz left join gn on ({' and '.join(f'gn.{i.strip()} = sd.{i.strip()}' for i in ids.split(','))}) and gn.language = sz.language),
dt as (select {ids}, arg_min(language, {{'n': -round(s, 9), 'l': language}}) detected from sc group by all)"""


def transcripts_by_language(spark, sf_dir):
    """Counts of the words the transcripts of each language's leagues use."""
    s = segments(spark, sf_dir).join(table(spark, sf_dir, "leagues").select("league", "lang"), "league")
    return guards.word_counts(s, "text", "lang")


S_FAMILY = "case lang " + " ".join(f"when '{k}' then detected in ({', '.join(repr(m) for m in v)})" for k, v in T.FAMILIES.items()) + " else detected = lang end"


@query("ref_p4_wrong_language", f"with {SEG}, lt as (select seg_key, text, lang from seg join leagues using (league) where len({s_words('text')}) >= 15), {s_detected('lt', 'seg_key')} select seg_key, lang, detected from lt join dt using (seg_key) where not ({S_FAMILY})")
def p4(spark, sf_dir):
    """[P4] Segments of 15 words and more outside their league's family, by the words the leagues' own transcripts use."""
    s = segments(spark, sf_dir).where("text is not null").join(table(spark, sf_dir, "leagues").select("league", "lang"), "league").where(F.size(T.words(F.col("text"))) >= 15)
    d = s.join(guards.detected_languages(s, ["seg_key"], "text", transcripts_by_language(spark, sf_dir)), "seg_key", "left")
    return d.where(T.wrong_language(F.col("text"), F.col("detected"), F.col("lang"))).select("seg_key", "lang", "detected")


S_HEAD = "case " + " ".join(f"when detected in ({', '.join(repr(m) for m in v)}) then '{k}'" for k, v in T.FAMILIES.items()) + " else coalesce(detected, 'en') end"


@query(
    "ref_m1_match_language",
    f"""with {SEG}, lr as (select *, len({s_words('text')}) n, row_number() over (partition by match_id, feed order by len({s_words('text')}) desc, half, start_time, ord, segment_id) r from seg where text is not null),
lt as (select match_id, feed, string_agg(text, ' ' order by r) text from lr where r <= 20 and n >= 5 group by all), {s_detected('lt', 'match_id, feed')}
select match_id, feed, {S_HEAD} as language from (select distinct match_id, feed from seg where text is not null) left join dt using (match_id, feed)""",
)
def m1(spark, sf_dir):
    """[M1] The language of each match's longest segments."""
    detect = lambda texts: guards.detected_languages(texts, MATCH, "text", transcripts_by_language(spark, sf_dir))
    return guards.match_language(segments(spark, sf_dir).where("text is not null"), MATCH, ["half", "start_time", "ord", "segment_id"], "text", detect)


def cleaned(spark, sf_dir):
    s = with_language(spark, sf_dir)
    return s, *C.clean(s)


CLEANED = f"""{CLASSED}, o as (select *, {S_KEY} k, row_number() over (partition by match_id, feed, half order by round(start_time * 1000), ord, segment_id) rn from cls where reason is null), {FOLD},
fe as (select f.match_id, f.feed, f.half, anchor_id, max(o.end_time) e from f join o using (match_id, feed, half, segment_id) group by all),
k1 as (select o.* exclude (text, end_time), {S_W3} as text, coalesce(fe.e, o.end_time) end_time, coalesce(lang, 'en') as lg from o join f using (match_id, feed, half, segment_id) left join fe on fe.match_id = o.match_id and fe.feed = o.feed and fe.half = o.half and fe.anchor_id = o.segment_id left join leagues on leagues.league = o.league where kept)"""


@query("ref_clean_segments", f"with recursive {CLEANED} select match_id, feed, half, segment_id, start_time, end_time, {s_normal('text', 'lg')} as text from k1")
def clean_segments(spark, sf_dir):
    """The cleaned segments: filtered, merged, collapsed, normalised."""
    return cleaned(spark, sf_dir)[1].select(*HALF, "segment_id", "start_time", "end_time", "text")


@query(
    "ref_a14_summary",
    f"""with recursive {CLASSED}, o as (select *, {S_KEY} k, row_number() over (partition by match_id, feed, half order by round(start_time * 1000), ord, segment_id) rn from cls where reason is null), {FOLD},
n as (select match_id, feed, count(*) original, count(reason) hallucinations from cls group by all), d as (select match_id, feed, count(*) filter (not kept) duplicates from f group by all)
select match_id, feed, original, original - hallucinations - coalesce(duplicates, 0) as kept, hallucinations, coalesce(duplicates, 0) as duplicates, round_even((original - hallucinations - coalesce(duplicates, 0)) / original * 100, 1) as retention
from n left join d using (match_id, feed)""",
)
def a14(spark, sf_dir):
    return C.summary(C.staged(with_language(spark, sf_dir)))


@query("ref_f7_audit", f"with {SEG} select seg_key, count(*) as n from seg, lateral (select unnest(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)[^\\p{{L}}\\p{{N}}_](uh|um|eh|er|ah|hm|hmm|uhm|erm)[^\\p{{L}}\\p{{N}}_]', 1)) w) where text is not null group by 1")
def f7(spark, sf_dir):
    """The audit rows of removed hesitations, whose number SQL can check; all rows in ref_f7_audit_rows."""
    return f7_rows(spark, sf_dir).where("corrected = ''").groupBy("seg_key").agg(F.count("*").alias("n"))


@query("ref_f7_audit_rows")
def f7_rows(spark, sf_dir):
    """No SQL: positions in changing texts (brute force in the tests).  A row per removed hesitation and merged compound."""
    return with_language(spark, sf_dir).where("text is not null").select("seg_key", F.inline(T.normalisation_audit(F.col("text"), F.col("language"))))


@query("ref_k7_report_numbers", f"with {ONCE} select case when score >= 80 then 'high' when score >= 70 then 'medium' else 'low' end as band, count(*) as n from c where score is not null and not isnan(score) group by 1")
def k7(spark, sf_dir):
    return once(spark, sf_dir).where("score is not null and not isnan(score)").groupBy(T.confidence_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query("ref_k1_cleaned_documents")
def k1(spark, sf_dir):
    """No SQL: JSON text (round trip in the tests).  Every feed and match, with what cleaning removed and the corrections."""
    originals, kept, removed = cleaned(spark, sf_dir)
    return sinks.cleaned_documents(kept, once(spark, sf_dir), removed, originals)


def s_places(c: str) -> str:
    """A time in whole milliseconds to two places, half to even, as text."""
    ms = f"round({c} * 1000)::bigint"
    return f"coalesce(((({ms} // 10 + case when {ms} % 10 > 5 or ({ms} % 10 = 5 and ({ms} // 10) % 2 = 1) then 1 else 0 end) / 100.0)::double)::varchar, 'null')"


@query(
    "ref_k4_export",
    f"""with {SEG}, e as (select match_id, feed, half, ord, '"' || segment_id || '": [' || {s_places('start_time')} || ', ' || {s_places('end_time')} || ', ' || coalesce(to_json(text)::varchar, 'null') || ']' it from seg),
b as (select match_id, feed, half, string_agg(it, ', ' order by ord, it) its from e group by match_id, feed, half),
p as (select match_id, feed, half, 'Part ' || half || chr(10) || chr(10) || '{{"segments": {{' || its || '}}}}' blk from b)
select match_id, feed, string_agg(blk, chr(10) || chr(10) order by half) as value from p group by match_id, feed""",
)
def k4(spark, sf_dir):
    """Every segment of every feed, as the search takes it."""
    return sinks.export_blocks(segments(spark, sf_dir))


QUESTIONS = [("a1", "yellow card late challenge", ["yellow card"]), ("a2", "penalty bottom corner", ["penalty"]), ("b1", "supporters singing", ["singing"]), ("b2", "gardien frappe molle", ["gardien"]), ("c1", "hackentrick", ["Hackentrick"]), ("c2", "crosbar", ["crossbar"])]
S_Q = "q as (select * from (values " + ", ".join(f"('{i}', '{q}', '{t[0]}')" for i, q, t in QUESTIONS) + ") v(qid, query, target))"
S_AN = {"x": "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))", "y": "trim(regexp_replace(strip_accents(replace(lower({}), 'ø', 'o')), '[^a-z0-9]+', ' ', 'g'))"}


def s_field(f: str, weight: str, fuzzy: bool, p: str) -> str:
    """CTEs of one field's scores, named p + f + letter."""
    a, f = S_AN[f], p + f
    most = "case when length(asked) >= 6 then 2 when length(asked) >= 3 then 1 else 0 end"
    near = f"abs(length(asked) - length(term)) <= {most} and levenshtein(asked, term) <= {most}" if fuzzy else "asked = term"
    return f"""{f}d as (select seg_key, unnest(list_filter(string_split({a.format('text')}, ' '), lambda v: v <> '')) term, len(list_filter(string_split({a.format('text')}, ' '), lambda v: v <> '')) dl from seg where text is not null),
{f}p as (select term, seg_key, count(*) tf, any_value(dl) dl from {f}d group by all), {f}v as (select term, count(*) df from {f}p group by 1), {f}n as (select count(*) n, avg(dl) avgdl from (select distinct seg_key, dl from {f}p)),
{f}t as (select distinct qid, unnest(list_filter(string_split({a.format('query')}, ' '), lambda v: v <> '')) asked from q),
{f}e as (select qid, asked, term, max(df) over (partition by qid, asked) df, 1 - levenshtein(asked, term)::double / least(length(asked), length(term)) boost from {f}t, {f}v where {near}),
{f}b as (select qid, asked, seg_key, max(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) part from {f}p join {f}e using (term), {f}n group by all), {f}s as (select qid, seg_key, {weight} * sum(part) s from {f}b group by all)"""


def s_search(fuzzy: bool = True, p: str = "") -> str:
    """CTEs of the search up to p + 'top'."""
    x, y = f"{p}xs", f"{p}ys"
    return f"""{s_field('x', '2.0', fuzzy, p)}, {s_field('y', '1.0', fuzzy, p)},
{p}z as (select qid, seg_key, greatest(coalesce({x}.s, 0), coalesce({y}.s, 0)) s from {x} full join {y} using (qid, seg_key)),
{p}r as (select z.qid, seg.match_id, z.seg_key, s + case when contains(' ' || {S_AN['x'].format('text')} || ' ', ' ' || {S_AN['x'].format('query')} || ' ') then 5 else 0 end + case when contains(' ' || {S_AN['y'].format('text')} || ' ', ' ' || {S_AN['y'].format('query')} || ' ') then 5 else 0 end score from {p}z z join seg using (seg_key) join q using (qid)),
{p}top as (select *, row_number() over (partition by qid, match_id order by round(score, 9) desc, seg_key) n from {p}r where score >= 5)"""


S_SEARCH = f"with {SEG}, {S_Q}, {s_search()}"


def hits(spark, sf_dir):
    docs = segments(spark, sf_dir).where("text is not null").select("seg_key", "match_id", "text")
    queries = spark.createDataFrame([(i, q) for i, q, _ in QUESTIONS], "qid string, query string")
    return docs, search.lexical_search(docs, queries, "seg_key", "text", "match_id", min_score=5.0)


@query("ref_m14_lexical_search", f"{S_SEARCH} select qid, match_id, seg_key, round(score, 5) as score, n from top where n <= 5")
def m14(spark, sf_dir):
    """[M14, P8] Ranked search with fuzzy terms and phrases, best five of each match, scores under 5 dropped."""
    return hits(spark, sf_dir)[1].withColumn("score", F.round("score", 5))


@query("ref_a17_hit_rate", f"{S_SEARCH} select qid[1] as category, count(*) as queries, avg(case when contains(lower(text), lower(target)) then 1.0 else 0.0 end) as hit_rate, round(avg(score), 5) as mean_score from top join seg using (seg_key) join q using (qid) where n = 1 group by 1")
def a17(spark, sf_dir):
    """[A17, A18] Share of first hits that have the target, and their mean score, by category."""
    docs, found = hits(spark, sf_dir)
    targets = spark.createDataFrame([(i, t) for i, _, t in QUESTIONS], "qid string, targets array<string>")
    return search.top_hits(found, docs, "seg_key", "text", targets).withColumn("mean_score", F.round("mean_score", 5))


@query(
    "ref_a18_compared_runs",
    f"""{S_SEARCH}, {s_search(False, 's')}, t1 as (select top.qid, score, contains(lower(text), lower(target)) hit from top join seg using (seg_key) join q using (qid) where n = 1), t2 as (select stop.qid, score, contains(lower(text), lower(target)) hit from stop join seg using (seg_key) join q using (qid) where n = 1),
a as (select count(*) queries, avg(hit::int) hit_rate, avg(score) mean_score from t1), b as (select count(*) queries, avg(hit::int) hit_rate, avg(score) mean_score from t2)
select 'fuzzy' as run, queries, round(hit_rate, 5) as hit_rate, round(mean_score, 4) as mean_score, null::double as relative from a union all select 'strict', queries, round(hit_rate, 5), round(mean_score, 4), null from b
union all select 'delta', b.queries - a.queries, round(b.hit_rate - a.hit_rate, 5), round(b.mean_score - a.mean_score, 4), round((b.mean_score - a.mean_score) / a.mean_score * 100, 4) from a, b""",
)
def a18(spark, sf_dir):
    """[A18, K10] The search with and without fuzzy terms: first hits with the target, mean first score, and what changes."""
    docs, found = hits(spark, sf_dir)
    queries = spark.createDataFrame([(i, q) for i, q, _ in QUESTIONS], "qid string, query string")
    strict = search.lexical_search(docs, queries, "seg_key", "text", "match_id", fuzzy=False, min_score=5.0)
    targets = spark.createDataFrame([(i, t) for i, _, t in QUESTIONS], "qid string, targets array<string>")
    out = search.compared_runs(found, strict, docs, "seg_key", "text", targets, ("fuzzy", "strict"))
    return out.select("run", "queries", F.round("hit_rate", 5).alias("hit_rate"), F.round("mean_score", 4).alias("mean_score"), F.round("relative", 4).alias("relative"))


@query("ref_m15_vector_search", "with p as (select a.vec_id q, b.vec_id v, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by q order by round(s, 9) desc, v) n from p) select q as query_id, v as vec_id, round(s, 6) as score, n from r where n <= 5")
def m15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("ref_m15_score_sum", f"""{S_SEARCH},
v as (select i.qid, b.vec_id seg_key, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from (select qid, row_number() over (order by qid) * 20 - 20 vec_id from q) i join embeddings a using (vec_id) join embeddings b on a.vec_id <> b.vec_id),
vt as (select *, row_number() over (partition by qid order by round(s, 9) desc, seg_key) n from v), u as (select qid, seg_key, score from top where n <= 5 union all select qid, seg_key, s from vt where n <= 5),
z2 as (select qid, seg_key, sum(score) score from u group by all) select qid, seg_key, round(score, 5) as score, row_number() over (partition by qid order by round(score, 9) desc, seg_key) as n from z2""")
def m15_sum(spark, sf_dir):
    """[M15] Lexical and vector hits of the same queries, their scores added up (query k stands at vector 20 k)."""
    e = table(spark, sf_dir, "embeddings")
    ids = spark.createDataFrame([(q, 20 * k) for k, q in enumerate(sorted(i for i, _, _ in QUESTIONS))], "qid string, query_id long")
    near = search.nearest_vectors(e, e.join(F.broadcast(ids), e["vec_id"] == ids["query_id"], "left_semi"), "vec_id", "embedding").join(ids, "query_id").select("qid", F.col("vec_id").alias("seg_key"), "score")
    return search.summed([hits(spark, sf_dir)[1], near], ["qid", "seg_key"]).withColumn("score", F.round("score", 5))


@query("ref_m17_relevant_hits", f"{S_SEARCH}, r17 as (select top.qid, match_id, seg_key, top.n, contains(lower(seg.text), lower(target)) kept from top join seg using (seg_key, match_id) join q using (qid) where top.n <= 5) select qid, match_id, seg_key, n from r17 where kept and qid not in (select qid from r17 group by qid having not bool_or(kept))")
def m17(spark, sf_dir):
    """The hits an injected judge keeps (here: one that looks for the labelled target), none of queries it refuses."""
    docs, found = hits(spark, sf_dir)
    wanted = {q: t[0] for _, q, t in QUESTIONS}
    judge = lambda rows: pd.Series([wanted[q].lower() in (t or "").lower() for q, t in zip(rows["query"], rows["text"])], dtype=bool)
    asked = spark.createDataFrame([(i, q) for i, q, _ in QUESTIONS], "qid string, query string")
    shown = found.join(docs.select("seg_key", "text"), "seg_key").join(asked, "qid")
    return names.relevant_hits(shown, judge).select("qid", "match_id", "seg_key", "n")


@query(
    "ref_m9_guarded_edits",
    f"""with recursive {SEG}, {HEARD}, {MASKED},
g as (select m.seg_key, text as original, len(list_filter(mask, lambda x: x))::int n_wrapped, {s_strip("array_to_string(list_transform(range(1, len(ws) + 1), lambda i: case when mask[i] then lower(ws[i]) else ws[i] end), ' ')")} p from m join seg using (seg_key)),
h as (select *, case when regexp_matches(p, '^[\"''].*[\"'']$') then {s_strip('substring(p, 2, greatest(length(p) - 2, 0))')} else p end q from g),
c as (select *, case when n_wrapped < 2 then 'skipped_below_min' when q = '' or q = original then 'no_op' when {' or '.join(f"contains(q, '{m}')" for m in T.ECHO_MARKERS)} then 'rejected_prompt_echo' else 'accepted' end outcome from h)
select seg_key, original, case when outcome = 'accepted' then q else original end as text, n_wrapped, outcome from c""",
)
def m9(spark, sf_dir):
    """[M9, F19-F22] A model's edits behind the guards; the model is injected, here one that lower-cases the words it may edit."""
    import re

    lower = lambda df: df["wrapped"].map(lambda t: re.sub(r"<([^<>]+)>", lambda m: m[1].lower(), t))
    s = segments(spark, sf_dir).where("text is not null").withColumn("at", whole_order(F.col("half"), millis("start_time"))).withColumn("whole", F.concat_ws("/", "match_id", "feed"))
    return guards.guarded_edits(s, ["seg_key"], "whole", ["at", "ord", "segment_id"], "text", "words", "frozen_word_indices", lower)


@query("ref_m10_restored", f"with {SEG}, n as (select seg_key, text as original, {s_restored('@@')} as text from seg where text is not null) select *, text <> original as changed from n".replace("@@", "''"))
def m10(spark, sf_dir):
    """[M10, F24] Punctuation by an injected labeller; here one that finds no stop missing, so sentence starts get capitals."""
    none = lambda s: s.map(lambda t: [""] * len(t.split()))
    return guards.restored(segments(spark, sf_dir).where("text is not null"), ["seg_key"], "text", none)
