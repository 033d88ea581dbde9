"""Queries of alignment and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import align
from touchline.operators import evaluate as E
from touchline.plans.registry import W, query, s_strip, s_words
from touchline.sources.tables import HALF, table

REF = "r as (select distinct on (ref_id) * from timed_ref where text is not null)"
HYP = "h as (select distinct on (hyp_id) * from timed_hyp where text is not null)"
ON = "r.match_id = h.match_id and r.feed = h.feed and r.half = h.half and r.end_sec is not null and h.end_sec is not null"
SPAN = ("start_sec", "end_sec")


def timed(spark, sf_dir):
    """Both sides without redelivered rows and null texts."""
    return (
        table(spark, sf_dir, "timed_ref").where("text is not null").dropDuplicates(["ref_id"]),
        table(spark, sf_dir, "timed_hyp").where("text is not null").dropDuplicates(["hyp_id"]),
    )


OVER = "least(r.end_sec, h.end_sec) - greatest(r.start_sec, h.start_sec)"


@query("ref_j5_overlap", f"with {REF}, {HYP} select r.match_id, r.feed, r.half, ref_id, hyp_id, {OVER} as overlap_s from r join h on {ON} and {OVER} >= 0.25")
def j5(spark, sf_dir):
    r, h = timed(spark, sf_dir)
    return align.overlap_join(r, h, HALF, "ref_id", "hyp_id", *SPAN, least_s=0.25)


@query("ref_j6_overlap_strict", f"with {REF}, {HYP} select r.match_id, r.feed, r.half, ref_id, hyp_id, {OVER} as overlap_s from r join h on {ON} and h.start_sec < r.end_sec and h.end_sec > r.start_sec and {OVER} > 0")
def j6(spark, sf_dir):
    r, h = timed(spark, sf_dir)
    return align.overlap_join(r, h, HALF, "ref_id", "hyp_id", *SPAN)


WIN = f"""{REF}, {HYP}, j as (select ref_id, count(*) n_hyp, string_agg(h.text, ' ' order by h.start_sec, hyp_id) hyp_text from r join h on {ON} and {OVER} >= 0.25 group by ref_id),
w as (select match_id, feed, half, ref_id, r.text as ref_text, r.start_sec, coalesce(n_hyp, 0) n_hyp, coalesce(hyp_text, '') hyp_text from r left join j using (ref_id))"""


def windowed(spark, sf_dir):
    r, h = timed(spark, sf_dir)
    return align.windows(r, h, HALF, "ref_id", "hyp_id", *SPAN, "text").join(r.select("ref_id", "start_sec"), "ref_id")


@query("ref_j5_windows", f"with {WIN} select match_id, feed, half, ref_id, n_hyp, hyp_text from w")
def j5_windows(spark, sf_dir):
    return windowed(spark, sf_dir).select(*HALF, "ref_id", "n_hyp", "hyp_text")


@query("ref_j9_uncovered", f"with {REF}, {HYP} select hyp_id, text from h where not exists (select 1 from r where {ON} and r.start_sec < h.end_sec and h.start_sec < r.end_sec)")
def j9(spark, sf_dir):
    r, h = timed(spark, sf_dir)
    return align.uncovered(h, r, HALF, "hyp_id", "ref_id", *SPAN).select("hyp_id", "text")


S_SIDE = """rl as (select match_id, feed, half, list({'id': ref_id, 's': start_sec, 'e': coalesce(end_sec, start_sec)} order by round(start_sec * 1000), ref_id) r from r where start_sec is not null group by all),
hl as (select match_id, feed, half, list({'id': hyp_id, 's': start_sec, 'e': coalesce(end_sec, start_sec)} order by round(start_sec * 1000), hyp_id) h from h where start_sec is not null group by all),
b as (select match_id, feed, half, coalesce(r, []) r, coalesce(h, []) h from rl full join hl using (match_id, feed, half))"""


@query(
    "ref_j7_merge_by_time",
    f"""with recursive {REF}, {HYP}, {S_SIDE},
f as (select match_id, feed, half, 1 i, 1 j, null::bigint ref_id, null::bigint hyp_id, 0 n from b
  union all select b.match_id, b.feed, b.half, i + (c in ('both', 'ref'))::int, j + (c in ('both', 'hyp'))::int, case when c in ('both', 'ref') then r[i].id end, case when c in ('both', 'hyp') then h[j].id end, n + 1
  from f join b using (match_id, feed, half), lateral (select case when j > len(h) then 'ref' when i > len(r) then 'hyp'
    when abs((r[i].s + r[i].e) - (h[j].s + h[j].e)) <= 1.5 or (r[i].s < h[j].e and h[j].s < r[i].e) then 'both' when r[i].e <= h[j].s then 'ref' else 'hyp' end c) where i <= len(r) or j <= len(h))
select match_id, feed, half, ref_id, hyp_id from f where n > 0""",
)
def j7(spark, sf_dir):
    """[J7] The two-pointer walk."""
    r, h = timed(spark, sf_dir)
    return align.merge_by_time(r, h, HALF, "ref_id", "hyp_id", *SPAN)


@query(
    "ref_j8_take_nearest",
    f"""with recursive {REF}, {HYP}, {S_SIDE},
f as (select match_id, feed, half, 0 i, []::bigint[] used, null::bigint hyp_id from b where len(r) > 0
  union all select b.match_id, b.feed, b.half, i + 1, case when k is null then used else list_append(used, k) end, case when k is not null then h[k].id end
  from f join b using (match_id, feed, half), lateral (select arg_min(k, {{'d': abs((r[i + 1].s + r[i + 1].e) / 2 - (h[k].s + h[k].e) / 2), 'k': k}}) k from (select unnest(range(1, len(h) + 1)) k)
    where not list_contains(used, k) and abs((r[i + 1].s + r[i + 1].e) / 2 - (h[k].s + h[k].e) / 2) <= 0.75 + (h[k].e - h[k].s) / 2) where i < len(r))
select match_id, feed, half, r[i].id as ref_id, hyp_id from f join b using (match_id, feed, half) where i > 0""",
)
def j8(spark, sf_dir):
    """[J8] Greedy and consuming."""
    r, h = timed(spark, sf_dir)
    return align.take_nearest(r, h, HALF, "ref_id", "hyp_id", *SPAN)


@query(
    "ref_j15_fallback",
    f"""with {WIN}, k as (select ref_id, string_agg(h.text, ' ' order by h.start_sec, hyp_id) t from r join h on {ON} and {OVER} > 0 group by ref_id)
select w.ref_id, case when n_hyp > 0 then hyp_text else coalesce(k.t, '') end as text, n_hyp = 0 as ref_only from w left join k using (ref_id)""",
)
def j15(spark, sf_dir):
    """References without a hypothesis over a quarter second take, by their id, the text of a second alignment without a minimum, else ''."""
    r, h = timed(spark, sf_dir)
    second = align.windows(r, h, HALF, "ref_id", "hyp_id", *SPAN, "text", least_s=None)
    return align.with_fallback(windowed(spark, sf_dir), second, "ref_id", "hyp_text", "n_hyp").select("ref_id", F.col("hyp_text").alias("text"), "ref_only")


def s_alt(x: str) -> str:
    return s_strip(f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_'']', ' ', 'g'), '{W}+', ' ', 'g')")


CODES = "array_to_string(list_transform({}, lambda v: chr((32 + list_position(d, v))::int)), '')"


PAIRED = f"""p as (select match_id, feed, half, string_split({s_alt('ref_text')}, ' ') a, list_filter(string_split({s_alt('hyp_text')}, ' '), lambda v: v <> '') b from w where {s_alt('ref_text')} <> ''),
q as (select *, list_distinct(list_concat(a, b)) d from p),
e as (select match_id, feed, half, len(a) n, levenshtein({CODES.format('a')}, {CODES.format('b')}) x from q)"""


@query(
    "ref_a10_pairwise_wer",
    f"""with {WIN}, {PAIRED} select match_id, feed, half, sum(n)::bigint as ref_words, sum(x)::bigint as errors, sum(x)::double / sum(n) as wer from e group by all""",
)
def a10(spark, sf_dir):
    out = E.pairwise_wer(windowed(spark, sf_dir), HALF, "ref_text", "hyp_text")
    return out.select(*HALF, "ref_words", (F.col("substitutions") + F.col("insertions") + F.col("deletions")).alias("errors"), "wer")


@query("ref_a9_corpus_error")
def a9(spark, sf_dir):
    """No SQL: alignment of whole halves (tested against plain dynamic programming)."""
    return E.corpus_error(windowed(spark, sf_dir), HALF, ["start_sec", "ref_id"], "ref_text", "hyp_text")


BARE = "trim(v, '" + T.WER_PUNCT.replace("'", "''") + "')"


@query(
    "ref_a11_without_names",
    f"""with {WIN} select ref_id, array_to_string(list_filter(list_transform(list_filter(list_transform({s_words('ref_text')}, lambda v: {BARE}), lambda v: v <> '' and not (regexp_matches(v, '^\\p{{Lu}}') and regexp_matches(v, '\\p{{Ll}}'))),
 lambda v: translate(lower(v), '{T.WER_PUNCT.replace("'", "''")}', '')), lambda v: v <> ''), ' ') as text from w""",
)
def a11(spark, sf_dir):
    return windowed(spark, sf_dir).select("ref_id", E.without_names(F.col("ref_text")).alias("text"))


def s_names(x: str) -> str:
    return f"list_transform(list_filter(list_transform({s_words(x)}, lambda v: {BARE}), lambda v: length(v) >= 3 and regexp_matches(v, '^\\p{{Lu}}') and regexp_matches(v, '\\p{{Ll}}')), lambda v: lower(v))"


S_F1 = """case when r + h = 0 then 1.0 when h = 0 then 0.0 else b::double / h end as precision, case when r + h = 0 then 1.0 when h = 0 then 0.0 when r = 0 then 1.0 else b::double / r end as recall"""


@query(
    "ref_a12_entity_f1",
    f"""with {WIN}, t as (select match_id, feed, half, unnest({s_names('ref_text')}) t, 1 r, 0 h from w union all select match_id, feed, half, unnest({s_names('hyp_text')}), 0, 1 from w),
s as (select match_id, feed, half, t, max(r) r, max(h) h from t group by all), n as (select match_id, feed, half, sum(r) r, sum(h) h, sum(r * h) b from s group by all),
a as (select match_id, feed, half, coalesce(r, 0) r, coalesce(h, 0) h, coalesce(b, 0) b from (select distinct match_id, feed, half from w) left join n using (match_id, feed, half)),
p as (select match_id, feed, half, {S_F1} from a)
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from p""",
)
def a12(spark, sf_dir):
    return E.entity_f1(windowed(spark, sf_dir), HALF, "ref_text", "hyp_text")


S_CLEAN = "list_distinct(list_transform({}, lambda v: lower(rtrim(rtrim(trim(v, '.,;:!?\"''()[]{{}}'), '''s'), ''''))))"


@query(
    "ref_a13_listed_f1",
    f"""with {WIN}, g as (select distinct lower(v) t from (select unnest(string_split(canonical, ' ')) v from gazetteer) where length(v) >= 4),
t as (select match_id, feed, half, ref_id, unnest({S_CLEAN.format(s_words('ref_text'))}) t, 1 r, 0 h from w union all select match_id, feed, half, ref_id, unnest({S_CLEAN.format(s_words('hyp_text'))}), 0, 1 from w),
s as (select match_id, feed, half, ref_id, t, max(r) r, max(h) h from t where t in (select t from g) group by all)
select match_id, feed, half, sum(r * h)::bigint as tp, sum((1 - r) * h)::bigint as fp, sum(r * (1 - h))::bigint as fn from s group by all""",
)
def a13(spark, sf_dir):
    words = table(spark, sf_dir, "gazetteer").select(F.explode(F.split("canonical", " ")).alias("w")).where(F.length("w") >= 4)
    return E.listed_f1(windowed(spark, sf_dir), HALF, "ref_text", "hyp_text", words, "w").select(*HALF, "tp", "fp", "fn")


@query("ref_a27_metrics")
def a27(spark, sf_dir):
    """No SQL, as of A9."""
    return E.metrics(windowed(spark, sf_dir), HALF, ["start_sec", "ref_id"], "ref_text", "hyp_text")


A28 = f"""wr as (select match_id, feed, half, sum(x)::double / sum(n) wer from e group by all),
nt as (select match_id, feed, half, unnest({s_names('ref_text')}) t, 1 r, 0 h from w union all select match_id, feed, half, unnest({s_names('hyp_text')}), 0, 1 from w),
ns as (select match_id, feed, half, t, max(r) r, max(h) h from nt group by all), nn as (select match_id, feed, half, sum(r) r, sum(h) h, sum(r * h) b from ns group by all),
na as (select match_id, feed, half, coalesce(r, 0) r, coalesce(h, 0) h, coalesce(b, 0) b from (select distinct match_id, feed, half from w) left join nn using (match_id, feed, half)),
np as (select match_id, feed, half, {S_F1} from na), m as (select match_id, feed, half, wer, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end f1 from wr join np using (match_id, feed, half))"""


@query(
    "ref_a28_improvement",
    f"""with {WIN}, {PAIRED}, {A28}, b as (select match_id, arg_min(wer, (feed, half)) wer, arg_min(f1, (feed, half)) f1, min((feed, half)) o from m group by all),
x as (select m.match_id, min(m.wer) wer, arg_min(m.f1, (m.wer, m.feed, m.half)) f1 from m join b on m.match_id = b.match_id and (m.feed, m.half) > b.o group by all)
select b.match_id, b.wer as baseline, x.wer as best, b.wer - x.wer as delta, case when b.wer = 0 then 0.0 else (b.wer - x.wer) / b.wer * 100 end as relative, x.f1 - b.f1 as f1_delta from b join x on b.match_id = x.match_id""",
)
def a28(spark, sf_dir):
    """Error rate and entity F1 of each feed and half of a match: the best of the later rows against the first."""
    w = windowed(spark, sf_dir)
    rows = E.pairwise_wer(w, HALF, "ref_text", "hyp_text").select(*HALF, "wer").join(E.entity_f1(w, HALF, "ref_text", "hyp_text").select(*HALF, "f1"), list(HALF))
    return E.improvement(rows.withColumn("o", F.struct("feed", "half")), ["match_id"], "o")
