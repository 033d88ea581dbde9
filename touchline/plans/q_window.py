"""Queries of the order-dependent operators, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import folds, guards
from touchline.operators.ordered import entity, millis, whole_order, with_neighbours, with_rank
from touchline.plans.registry import W, query, s_indel, s_strip, s_words
from touchline.sources.tables import HALF, table

SEG = "seg as (select distinct on (match_id, feed, half, segment_id) * from segments)"
MATCH = ("match_id", "feed")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without redelivered rows."""
    return table(spark, sf_dir, "segments").dropDuplicates([*HALF, "segment_id"])


def with_language(spark, sf_dir):
    return segments(spark, sf_dir).join(table(spark, sf_dir, "leagues").select("league", F.col("lang").alias("language")), "league", "left").withColumn("language", F.coalesce("language", F.lit("en")))


S_KEY = "lower(" + s_strip("rtrim(" + s_strip("coalesce(text, '')") + ", '.,!?;:')") + ")"
ORDERED = f"o as (select *, {S_KEY} k, row_number() over (partition by match_id, feed, half order by round(start_time * 1000), ord, segment_id) rn from seg)"
# the fold over the rows of o; a pair of texts is only measured letter by letter if lengths and edits (of bytes, four a letter at most) allow 95
FOLD = f"""f as (select match_id, feed, half, rn, segment_id, k, k as anchor, segment_id as anchor_id, true as kept from o where rn = 1
  union all select o.match_id, o.feed, o.half, o.rn, o.segment_id, o.k,
    case when same then f.anchor else o.k end, case when same then f.anchor_id else o.segment_id end, not same
  from f join o on o.match_id = f.match_id and o.feed = f.feed and o.half = f.half and o.rn = f.rn + 1,
  lateral (select case when f.anchor = '' or o.k = '' then false when f.anchor = o.k then true
    when 2.0 * least(length(f.anchor), length(o.k)) < 0.95 * (length(f.anchor) + length(o.k)) then false
    when levenshtein(f.anchor, o.k) > 0.2 * (length(f.anchor) + length(o.k)) then false
    else {s_indel('f.anchor', 'o.k')} >= 95 end same) l)"""


@query("ref_w1_near_duplicates", f"with recursive {SEG}, {ORDERED}, {FOLD} select match_id, feed, half, segment_id, kept, case when not kept then anchor_id end as duplicate_of from f")
def w1(spark, sf_dir):
    out = folds.merge_near_duplicates(segments(spark, sf_dir), HALF, "segment_id", "start_time", "end_time", "ord", "text")
    return out.select(*HALF, "segment_id", "kept", "duplicate_of")


@query(
    "ref_w1_equal_neighbours",
    f"""with {SEG}, {ORDERED}, g as (select *, sum(case when k = lag_k and k <> '' then 0 else 1 end) over (partition by match_id, feed, half order by rn) i
  from (select *, lag(k) over (partition by match_id, feed, half order by rn) lag_k from o))
select match_id, feed, half, arg_min(segment_id, rn) as segment_id, max(end_time) as end_time, count(*) as n from g group by match_id, feed, half, i""",
)
def w1_equal(spark, sf_dir):
    return folds.merge_equal_neighbours(segments(spark, sf_dir), HALF, "segment_id", "start_time", "end_time", "ord", "text")


S_LONE = s_strip("rtrim(" + s_strip("text") + ", '.,!?;:')")
STUCK = f"""a as (select match_id, feed, half, segment_id, round(start_time * 1000)::bigint t, lower(x) token from (select *, {S_LONE} x from seg where text is not null)
  where len({s_words('x')}) = 1 and regexp_matches(x, '^\\p{{Lu}}') and regexp_matches(x, '\\p{{Ll}}') and start_time is not null),
b as (select *, row_number() over (partition by match_id, feed, token order by t, half, segment_id) rn from a),
c as (select match_id, feed, token, half, segment_id, t, rn, t as first, rn as cl from b where rn = 1
  union all select b.match_id, b.feed, b.token, b.half, b.segment_id, b.t, b.rn, case when b.t - c.first <= 60000 then c.first else b.t end, case when b.t - c.first <= 60000 then c.cl else b.rn end
  from c join b on b.match_id = c.match_id and b.feed = c.feed and b.token = c.token and b.rn = c.rn + 1),
stuck as (select match_id, feed, half, segment_id, token from (select *, count(*) over (partition by match_id, feed, token, cl) n from c) where n >= 3)"""


@query("ref_w2_stuck_names", f"with recursive {SEG}, {STUCK} select * from stuck")
def w2(spark, sf_dir):
    return folds.stuck_names(segments(spark, sf_dir), MATCH, ("half", "segment_id"), "start_time", "text").select(*HALF, "segment_id", "token")


@query(
    "ref_w4_select_spans",
    """with recursive e as (select distinct on (entity_id) * from entities where start_char is not null and end_char is not null),
o as (select *, row_number() over (partition by match_id, feed, half, segment_id order by start_char, end_char - start_char desc, entity_id) rn from e),
f as (select match_id, feed, half, segment_id, rn, entity_id, end_char as last, true as ok from o where rn = 1
  union all select o.match_id, o.feed, o.half, o.segment_id, o.rn, o.entity_id, case when o.start_char >= f.last then o.end_char else f.last end, o.start_char >= f.last
  from f join o on o.match_id = f.match_id and o.feed = f.feed and o.half = f.half and o.segment_id = f.segment_id and o.rn = f.rn + 1)
select entity_id from f where ok""",
)
def w4(spark, sf_dir):
    e = table(spark, sf_dir, "entities").where("start_char is not null and end_char is not null").dropDuplicates(["entity_id"])
    listed = e.groupBy(*HALF, "segment_id").agg(F.sort_array(F.collect_list(F.struct("entity_id", F.col("start_char").alias("start"), F.col("end_char").alias("end")))).alias("s"))
    return listed.select(F.explode(folds.select_spans(F.col("s"))).alias("x")).select("x.entity_id")


SELECTED = """e as (select distinct on (entity_id) * from entities where start_char is not null and end_char > start_char),
eo as (select *, row_number() over (partition by match_id, feed, half, segment_id order by start_char, end_char - start_char desc, entity_id) rn from e),
ef as (select match_id, feed, half, segment_id, rn, entity_id, start_char, end_char, end_char as last, true as ok from eo where rn = 1
  union all select o.match_id, o.feed, o.half, o.segment_id, o.rn, o.entity_id, o.start_char, o.end_char, case when o.start_char >= f.last then o.end_char else f.last end, o.start_char >= f.last
  from ef f join eo o on o.match_id = f.match_id and o.feed = f.feed and o.half = f.half and o.segment_id = f.segment_id and o.rn = f.rn + 1)"""


@query(
    "ref_w5_splice",
    f"""with recursive {SEG}, {SELECTED},
o as (select seg_key, seg.text, start_char, end_char, entity_id, row_number() over (partition by seg_key order by start_char desc, entity_id) rn
  from ef join seg using (match_id, feed, half, segment_id) where ok and seg.text is not null),
f as (select seg_key, rn, substring(text, 1, start_char) || '<' || entity_id || '>' || substring(text, end_char + 1) as out from o where rn = 1
  union all select o.seg_key, o.rn, substring(f.out, 1, o.start_char) || '<' || o.entity_id || '>' || substring(f.out, o.end_char + 1) from f join o on o.seg_key = f.seg_key and o.rn = f.rn + 1)
select seg_key, arg_max(out, rn) as out from f group by seg_key""",
)
def w5(spark, sf_dir):
    """The spans that ``select_spans`` leaves, each replaced by its id."""
    e = table(spark, sf_dir, "entities").where("start_char is not null and end_char > start_char").dropDuplicates(["entity_id"]).select(*HALF, "segment_id", "entity_id", "start_char", "end_char")
    listed = e.groupBy(*HALF, "segment_id").agg(F.sort_array(F.collect_list(F.struct("entity_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.concat(F.lit("<"), "entity_id", F.lit(">")).alias("new")))).alias("s"))
    s = segments(spark, sf_dir).where("text is not null").select(*HALF, "segment_id", "seg_key", "text")
    return s.join(listed, [*HALF, "segment_id"]).select("seg_key", folds.splice(F.col("text"), folds.select_spans(F.col("s"))).alias("out"))


@query(
    "ref_w6_time_chunks",
    f"with {SEG} select match_id, feed, half, k * 8.0::double as window_start, count(*) as n from seg, lateral (select unnest(range(greatest(floor((start_time - 12) / 8)::bigint + 1, 0), floor(start_time / 8)::bigint + 1)) k) where start_time >= 0 group by all",
)
def w6(spark, sf_dir):
    return folds.time_chunks(segments(spark, sf_dir), "start_time").groupBy(*HALF, "window_start").agg(F.count("*").alias("n"))


@query(
    "ref_w7_count_windows",
    f"""with {SEG}, o as (select *, row_number() over (partition by match_id, feed, half order by round(start_time * 1000), ord, segment_id) - 1 i from seg)
select match_id, feed, half, k as window_no, count(*) as n, min(start_time) as start_time from o, lateral (select unnest(range(greatest(ceil((i - 4) / 3.0)::bigint, 0), i // 3 + 1)) k) group by all""",
)
def w7(spark, sf_dir):
    return folds.count_windows(segments(spark, sf_dir), HALF, "start_time", ["ord", "segment_id"]).groupBy(*HALF, "window_no").agg(F.count("*").alias("n"), F.min("start_time").alias("start_time"))


@query(
    "ref_w8_merge_hits",
    f"""with {SEG}, h as (select match_id, feed, half, start_time, end_time, text from seg where end_time is not null and text is not null),
m as (select *, max(end_time) over (partition by match_id, feed, half order by start_time, end_time, text rows between unbounded preceding and 1 preceding) pe from h),
g as (select *, sum(case when start_time > pe + 2 then 1 else 0 end) over (partition by match_id, feed, half order by start_time, end_time, text) i from m)
select match_id, feed, half, min(start_time) as start_time, max(end_time) as end_time, count(*) as n, count(distinct text) as texts from g group by match_id, feed, half, i""",
)
def w8(spark, sf_dir):
    hits = segments(spark, sf_dir).where("end_time is not null and text is not null")
    return folds.merge_hits(hits, HALF, "start_time", "end_time", "text").withColumn("texts", F.size("texts").cast("long"))


S_BARE_WORDS = "list_transform({}, lambda v: lower(trim(v, ' .,!?;:''\"()-')))"


@query(
    "ref_w9_frozen_words",
    f"""with recursive {SEG}, c as (select distinct on (correction_id) * from corrections where stage = 'entity' and corrected is not null),
n as (select match_id, feed, half, segment_id, flatten(list({S_BARE_WORDS.format(s_words('corrected'))} order by correction_id)) want from c group by all),
t as (select seg_key, {S_BARE_WORDS.format(s_words('text'))} have, want from seg join n using (match_id, feed, half, segment_id) where text is not null),
f as (select seg_key, 0 k, []::int[] used from t
  union all select t.seg_key, k + 1, case when p is null then used else list_append(used, p) end
  from f join t using (seg_key), lateral (select min(i)::int p from (select unnest(range(0, len(have))) i) where have[i + 1] = want[k + 1] and not list_contains(used, i::int)) where k < len(want))
select t.seg_key, arg_max(used, k) as frozen from f join t using (seg_key) group by 1""",
)
def w9(spark, sf_dir):
    """Positions of the corrected names of each segment in its text."""
    c = table(spark, sf_dir, "corrections").where("stage = 'entity' and corrected is not null").dropDuplicates(["correction_id"])
    names = c.groupBy(*HALF, "segment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("correction_id", "corrected"))), lambda x: x["corrected"]).alias("names"))
    s = segments(spark, sf_dir).where("text is not null").select(*HALF, "segment_id", "seg_key", "text")
    return s.join(names, [*HALF, "segment_id"]).select("seg_key", folds.frozen_positions(T.words(F.col("text")), F.col("names")).alias("frozen"))


@query(
    "ref_w11_first_decision",
    """with c as (select distinct on (correction_id) * from corrections where stage = 'entity' and original is not null)
select match_id, lower(original) as key, count(*) as n, arg_min(corrected, correction_id) as decision, arg_min(method, correction_id) as method from c where corrected is not null group by all""",
)
def w11(spark, sf_dir):
    c = table(spark, sf_dir, "corrections").where("stage = 'entity' and original is not null and corrected is not null").dropDuplicates(["correction_id"])
    return c.groupBy("match_id", F.lower("original").alias("key")).agg(F.count("*").alias("n"), F.min_by("corrected", "correction_id").alias("decision"), F.min_by("method", "correction_id").alias("method"))


HEARD = f"""wt as (select seg_key, {s_words('text')} ws, words, list_transform(words, lambda h: trim(coalesce(h.word, ''), ' .,!?;:')) hs, coalesce(frozen_word_indices, []) fz from seg where text is not null),
wf as (select seg_key, 0 i, 1 nxt, 0 place from wt where len(hs) > 0
  union all select wt.seg_key, i + 1, case when p is null then len(hs) + 1 else p + 1 end::int, coalesce(p, 0)::int
  from wf join wt using (seg_key), lateral (select min(j) p from (select unnest(range(nxt, len(hs) + 1)) j) where hs[j] <> '' and (starts_with(ws[i + 1], hs[j]) or starts_with(hs[j], ws[i + 1]))) where i < len(ws)),
wp as (select seg_key, list(place order by i) places from wf where i > 0 group by 1)"""


@query("ref_w10_heard_places", f"with recursive {SEG}, {HEARD} select seg_key, array_to_string(places, ' ') as places from wp")
def w10(spark, sf_dir):
    """The recogniser's word each word of a text is paired with, where there are any."""
    bare = F.transform("words", lambda w: T.strip_chars(F.coalesce(w["word"], F.lit("")), " .,!?;:"))
    s = segments(spark, sf_dir).where("text is not null and size(words) > 0").withColumn("p", guards.heard_places(T.words(F.col("text")), bare)).where("size(p) > 0")
    return s.select("seg_key", F.array_join(F.transform("p", lambda x: x.cast("string")), " ").alias("places"))


MASKED = """m as (select seg_key, ws, list_transform(range(1, len(ws) + 1), lambda i: not list_contains(fz, (i - 1)::int) and case
  when len(hs) > 0 then case when places[i] > 0 and words[places[i]].prob > 0 then ln(words[places[i]].prob) else -10.0 end < -0.3
  else regexp_matches(ws[i], '^[A-ZÅÄÖÆØ][a-zà-ÿ]+([''-][A-Za-zÅÄÖÆØà-ÿ]+)*[.,!?;:]?$') end) mask from wt left join wp using (seg_key))"""


@query(
    "ref_f23_wrapped",
    f"""with recursive {SEG}, {HEARD}, {MASKED}
select seg_key, array_to_string(list_transform(range(1, len(ws) + 1), lambda i: case when mask[i] then '<' || ws[i] || '>' else ws[i] end), ' ') as wrapped, len(list_filter(mask, lambda x: x))::int as n_wrapped from m""",
)
def f23(spark, sf_dir):
    """[F23, W10] Uncertain words in <>: by the recogniser's probabilities, else by capitals."""
    return guards.with_wrapped(segments(spark, sf_dir).where("text is not null"), "text", "words", "frozen_word_indices").select("seg_key", "wrapped", "n_wrapped")


def in_match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments numbered within their match by half, start, ord, id."""
    s = segments(spark, sf_dir).select(entity(MATCH), "seg_key", whole_order(F.col("half"), millis("start_time")).alias("__t"), "ord", "segment_id")
    return with_rank(s, "__t", ["ord", "segment_id"])


@query(
    "ref_j13_neighbours",
    f"""with {SEG} select seg_key, lag(seg_key, 2) over w as before2, lag(seg_key) over w as before1, lead(seg_key) over w as after1 from seg
window w as (partition by match_id, feed order by half, start_time, ord, segment_id)""",
)
def j13(spark, sf_dir):
    """Context rows cross halves, as rows of a match are one list."""
    near = with_neighbours(in_match_order(spark, sf_dir), F.col("seg_key"), {"before2": -2, "before1": -1, "after1": 1})
    return near.select("seg_key", "before2", "before1", "after1")


@query("ref_t1_stable_sort", f"with {SEG} select seg_key, row_number() over (partition by match_id, feed order by half, start_time, ord, segment_id) as n from seg")
def t1(spark, sf_dir):
    return in_match_order(spark, sf_dir).select("seg_key", (F.col("__rank") + 1).alias("n"))


@query(
    "ref_t2_longest",
    f"with {SEG}, n as (select *, len({s_words('text')}) n, row_number() over (partition by match_id, feed order by len({s_words('text')}) desc, half, start_time, ord, segment_id) r from seg where text is not null) select match_id, feed, seg_key, n from n where r <= 20 and n >= 5",
)
def t2(spark, sf_dir):
    """The 20 longest segments of a match, of which those of five words and more."""
    s = segments(spark, sf_dir).where("text is not null").withColumn("n", F.size(T.words(F.col("text"))))
    w = Window.partitionBy(*MATCH).orderBy(F.desc("n"), "half", "start_time", "ord", "segment_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 20 and n >= 5").select(*MATCH, "seg_key", "n")


@query(
    "ref_t5_common_tokens",
    f"with {SEG} select lower(w) as token, count(*) as n from seg, lateral (select unnest({s_words('text')}) w) where text is not null group by 1 order by n desc, token limit 50",
)
def t5(spark, sf_dir):
    tokens = segments(spark, sf_dir).where("text is not null").select(F.explode(T.words(F.col("text"))).alias("w"))
    return tokens.groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query(
    "ref_t6_samples",
    "with c as (select distinct on (correction_id) * from corrections), r as (select *, row_number() over (partition by method order by correction_id) r from c) select method, correction_id from r where r <= 5",
)
def t6(spark, sf_dir):
    """At most five examples of each method."""
    w = Window.partitionBy("method").orderBy("correction_id")
    return table(spark, sf_dir, "corrections").dropDuplicates(["correction_id"]).withColumn("r", F.row_number().over(w)).where("r <= 5").select("method", "correction_id")


@query(
    "ref_t7_typed_lists",
    """with g as (select entity_type, canonical, row_number() over (partition by entity_type order by canonical) r from gazetteer)
select entity_type, string_agg(canonical, ', ' order by canonical) as names from g
where r <= case entity_type when 'player' then 30 when 'team' then 8 when 'coach' then 6 when 'referee' then 3 else 2 end group by 1""",
)
def t7(spark, sf_dir):
    cap = F.when(F.col("entity_type") == "player", 30).when(F.col("entity_type") == "team", 8).when(F.col("entity_type") == "coach", 6).when(F.col("entity_type") == "referee", 3).otherwise(2)
    listed = table(spark, sf_dir, "gazetteer").groupBy("entity_type").agg(F.sort_array(F.collect_list("canonical")).alias("names"))
    return listed.select("entity_type", F.array_join(F.slice("names", F.lit(1), cap), ", ").alias("names"))
