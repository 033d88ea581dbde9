"""Queries of gazetteers, name spans, retrieval, gates and the entity cascade."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.functions.similarity import indel_ratio
from touchline.operators import entity as N
from touchline.operators import gazetteer as G
from touchline.operators import names as M
from touchline.operators import search
from touchline.plans import clean as C
from touchline.plans.q_text import S_BOUND, S_CAPITALISED
from touchline.plans.q_window import HEARD, SEG, segments, with_language
from touchline.plans.registry import W, query, s_indel, s_strip, s_words
from touchline.session import cut_lineage
from touchline.sources.tables import HALF, table


def names(spark, sf_dir):
    return G.match_names(table(spark, sf_dir, "match_data"))


def s_part(c: str, kind: str, n: int) -> str:
    return f"select match_id, '{kind}' entity_type, unnest({c}) nm, generate_subscripts({c}, 1) - 1 + {n} * 100000 seq from match_data"


S_VENUES = f"list_transform(venue, lambda v: {s_strip('regexp_replace(v, ' + chr(39) + ' *[(].*?[)] *$' + chr(39) + ', ' + chr(39) + chr(39) + ')')})"
NAMES = f"""names as (select match_id, entity_type, {s_strip('nm')} canonical, seq from ({s_part('players', 'player', 0)} union all {s_part('referee', 'referee', 1)} union all {s_part('[home, away]', 'team', 2)}
 union all {s_part('teams', 'team', 3)} union all {s_part(S_VENUES, 'venue', 4)}) where nm is not null and {s_strip('nm')} <> '')"""
S_SUR = f"case when len({s_words('canonical')}) <= 1 then canonical else array_to_string({s_words('canonical')}[2:], ' ') end"
GAZ = f"""{NAMES}, gv as (select match_id, canonical, canonical variant, seq * 10 r from names union all select match_id, canonical, {S_SUR}, seq * 10 + 1 from names where entity_type in ('player', 'coach', 'referee')),
gaz as (select match_id, variant, arg_max(canonical, r) canonical from gv where variant <> '' group by all), types as (select match_id, canonical, arg_max(entity_type, seq) entity_type from names group by all)"""


def gazetteer(spark, sf_dir):
    return G.build_gazetteer(names(spark, sf_dir))


@query("ref_u4_gazetteer", f"with {GAZ} select * from gaz")
def u4(spark, sf_dir):
    return gazetteer(spark, sf_dir)


@query("ref_u4_entity_types", f"with {GAZ} select * from types")
def u4_types(spark, sf_dir):
    return G.entity_types(names(spark, sf_dir))


@query("ref_a22_first_names", f"with {GAZ} select match_id, lower(split_part(canonical, ' ', 1)) as first, string_agg(canonical, '|' order by canonical) as canonicals from types where entity_type in ('player', 'coach') and len({s_words('canonical')}) >= 2 and length(split_part(canonical, ' ', 1)) >= 4 group by all")
def a22(spark, sf_dir):
    return G.first_names(G.entity_types(names(spark, sf_dir))).withColumn("canonicals", F.array_join("canonicals", "|"))


@query("ref_a23_team_words", f"with {GAZ} select distinct match_id, lower(w) as word from (select match_id, unnest({s_words('canonical')}) w from types where entity_type in ('team', 'venue')) where length(w) >= 3")
def a23(spark, sf_dir):
    return G.team_words(G.entity_types(names(spark, sf_dir)))


@query(
    "ref_u2_prompt_names",
    f"""with {GAZ}, o as (select match_id, canonical, min(case entity_type when 'team' then 0 when 'player' then 1 else 2 end * 100000000 + seq) o from names group by all),
r as (select *, row_number() over (partition by match_id order by o, canonical) n from o) select match_id, string_agg(canonical, ', ' order by n) as hotwords, 'Names: ' || string_agg(canonical, ', ' order by n) as prompt from r where n <= 40 group by 1""",
)
def u2(spark, sf_dir):
    return G.prompt_names(names(spark, sf_dir))


@query(
    "ref_m5_context",
    f"""with {GAZ}, r as (select *, row_number() over (partition by match_id, entity_type order by canonical) n from types),
l as (select match_id, entity_type, string_agg(canonical, ', ' order by canonical) l from r where n <= case entity_type when 'team' then 8 when 'player' then 30 when 'coach' then 6 when 'referee' then 3 when 'venue' then 2 else 0 end group by all)
select match_id, string_agg(upper(entity_type[1]) || entity_type[2:] || 's: ' || l, chr(10) order by case entity_type when 'team' then 0 when 'player' then 1 when 'coach' then 2 when 'referee' then 3 else 4 end) as context from l group by 1""",
)
def m5(spark, sf_dir):
    return G.context_block(G.entity_types(names(spark, sf_dir)))


@query("ref_j1_segment_entities", f"with {SEG}, e as (select distinct on (entity_id) * from entities), n as (select match_id, feed, half, segment_id, count(*) n from e group by all) select seg_key, coalesce(n, 0) as n from seg left join n using (match_id, feed, half, segment_id)")
def j1(spark, sf_dir):
    n = table(spark, sf_dir, "entities").dropDuplicates(["entity_id"]).groupBy(*HALF, "segment_id").agg(F.count("*").alias("n"))
    return segments(spark, sf_dir).select(*HALF, "segment_id", "seg_key").join(n, [*HALF, "segment_id"], "left").select("seg_key", F.coalesce("n", F.lit(0)).alias("n"))


COR = "c as (select distinct on (correction_id) * from corrections where stage = 'entity' and original is not null and corrected is not null and corrected <> '')"


def corrections(spark, sf_dir):
    return table(spark, sf_dir, "corrections").where("stage = 'entity' and original is not null and corrected is not null and corrected <> ''").dropDuplicates(["correction_id"])


CACHE = f"""{COR}, a as (select lower(original) k, corrected, match_id, score, correction_id from c where score >= 75 and not isnan(score)), f as (select k, arg_min(corrected, correction_id) first from a group by 1),
s as (select a.k, f.first, a.match_id, arg_min(a.score, a.correction_id) score from a join f on a.k = f.k and a.corrected = f.first group by all),
cache as (select k as mishearing, first as correct, list_sort(list(match_id)) as matches_seen, sum(score) / count(*) as fuzzy_avg from s group by all)"""


def cache(spark, sf_dir):
    c = corrections(spark, sf_dir).where("not isnan(score)").select("match_id", F.lower("original").alias("key"), "corrected", F.col("score").alias("ratio"), F.col("correction_id").alias("ord"))
    return N.record_cache(None, c)


@query("ref_m13_cache_record", f"with {CACHE} select mishearing, correct, array_to_string(matches_seen, '|') as matches_seen, round(fuzzy_avg, 6) as fuzzy_avg from cache")
def m13(spark, sf_dir):
    return cache(spark, sf_dir).select("mishearing", "correct", F.array_join("matches_seen", "|").alias("matches_seen"), F.round("fuzzy_avg", 6).alias("fuzzy_avg"))


@query("ref_a19_running_mean", f"with {COR} select match_id, round(avg(score), 4) as mean, count(*) as n from c where score is not null and not isnan(score) group by 1")
def a19(spark, sf_dir):
    return corrections(spark, sf_dir).where("score is not null and not isnan(score)").groupBy("match_id").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))


@query("ref_j2_cache_lookup", f"with {CACHE} select entity_id, correct from (select distinct on (entity_id) * from entities) e join cache on lower(e.text) = mishearing where len(matches_seen) >= 1")
def j2(spark, sf_dir):
    known = cache(spark, sf_dir).where(F.size("matches_seen") >= 1)
    e = table(spark, sf_dir, "entities").dropDuplicates(["entity_id"]).select("entity_id", F.lower("text").alias("mishearing"))
    return e.join(known, "mishearing").select("entity_id", "correct")


TOKENS = f"tok as (select match_id, lower({{t}}) as token from (select match_id, unnest({s_words('text')}) w from seg where text is not null))"
S_FREQ = f"select match_id, lower(trim(w, ' .,!?;:''\"()-')) as token, count(*) as n from (select match_id, unnest({s_words('text')}) w from seg where text is not null) group by all"


def token_counts(spark, sf_dir):
    w = segments(spark, sf_dir).where("text is not null").select("match_id", F.explode(T.words(F.col("text"))).alias("w"))
    return w.groupBy("match_id", F.lower(T.strip_chars(F.col("w"), T.EDGE_PUNCT)).alias("token")).agg(F.count("*").alias("n"))


@query("ref_a1_token_frequency", f"with {SEG} {S_FREQ}")
def a1(spark, sf_dir):
    return token_counts(spark, sf_dir)


@query("ref_a2_frequency_gate", f"with {SEG}, f as ({S_FREQ}) select entity_id from (select distinct on (entity_id) * from entities) e join f on e.match_id = f.match_id and lower(e.text) = f.token where n >= 5")
def a2(spark, sf_dir):
    e = table(spark, sf_dir, "entities").dropDuplicates(["entity_id"]).select("entity_id", "match_id", F.lower("text").alias("token"))
    return e.join(token_counts(spark, sf_dir).where("n >= 5"), ["match_id", "token"]).select("entity_id")


S_CAP = f"""select match_id, t as token, count(*) as n from (select match_id, rtrim(rtrim(trim(w, '.,;:!?"''()[]{{}}'), '''s'), '''') t from (select match_id, unnest({s_words('text')}) w from seg where text is not null)) where length(t) >= 5 and regexp_matches(t, '^\\p{{Lu}}') group by all having count(*) >= 2"""


def capital_counts(spark, sf_dir):
    w = segments(spark, sf_dir).where("text is not null").select("match_id", F.explode(T.words(F.col("text"))).alias("w"))
    clean = F.regexp_replace(T.rstrip_possessive(T.strip_chars(F.col("w"), ".,;:!?\"'()[]{}")), "'+$", "")
    return w.select("match_id", clean.alias("token")).where((F.length("token") >= 5) & T.is_upper_first(F.col("token"))).groupBy("match_id", "token").agg(F.count("*").alias("n")).where("n >= 2")


@query("ref_a3_capitalised_counts", f"with {SEG} {S_CAP}")
def a3(spark, sf_dir):
    return capital_counts(spark, sf_dir)


@query(
    "ref_m12_seed_proposals",
    f"""with {SEG}, {GAZ}, t as ({S_CAP}), k as (select distinct match_id, canonical from gaz),
u as (select t.* from t where not exists (select 1 from k where k.match_id = t.match_id and lower(k.canonical) = lower(t.token))),
d as (select distinct token, canonical from u join k on u.match_id = k.match_id where 200.0 * least(length(token), length(canonical)) >= 80 * (length(token) + length(canonical))), r as (select token, canonical, {s_indel('token', 'canonical')} score from d),
x as (select u.match_id, u.token, k.canonical, score, n, row_number() over (partition by u.match_id, u.token order by score desc, k.canonical) i from u join k on u.match_id = k.match_id join r on r.token = u.token and r.canonical = k.canonical where score >= 80)
select match_id, token, canonical, round(score, 6) as score, n from x where i = 1""",
)
def m12(spark, sf_dir):
    out = N.seed_proposals(capital_counts(spark, sf_dir), gazetteer(spark, sf_dir))
    return out.select("match_id", "token", "canonical", F.round("score", 6).alias("score"), "n")


@query(
    "ref_t4_top_proposals",
    f"""with {SEG}, {GAZ}, t as ({S_CAP}), k as (select distinct match_id, canonical from gaz),
u as (select t.* from t where not exists (select 1 from k where k.match_id = t.match_id and lower(k.canonical) = lower(t.token))),
d as (select distinct token, canonical from u join k on u.match_id = k.match_id where 200.0 * least(length(token), length(canonical)) >= 80 * (length(token) + length(canonical))), r as (select token, canonical, {s_indel('token', 'canonical')} score from d),
x as (select u.match_id, u.token, k.canonical, score, n, row_number() over (partition by u.match_id, u.token order by score desc, k.canonical) i from u join k on u.match_id = k.match_id join r on r.token = u.token and r.canonical = k.canonical where score >= 80)
select match_id, token, canonical from x where i = 1 order by score * n desc, match_id, token limit 60""",
)
def t4(spark, sf_dir):
    return N.seed_proposals(capital_counts(spark, sf_dir), gazetteer(spark, sf_dir), show=60).select("match_id", "token", "canonical")


S_BARE4 = "trim(w, '.,!?;:''\"()-—–…')"
MIS = f"""{SEG}, {GAZ}, gw as (select distinct match_id, lower(w) word from (select match_id, unnest(list_concat({s_words('canonical')}, {s_words('variant')})) w from gaz) where length(w) >= 5),
tk as (select match_id, seg_key, {S_BARE4} t from (select match_id, seg_key, unnest({s_words('text')}) w from seg where text is not null)), tv as (select match_id, seg_key, t from tk where length(t) >= 5 and regexp_matches(t, '^[\\p{{L}}''\\-]+$') and regexp_matches(t, '\\p{{L}}')),
fresh as (select distinct match_id, lower(t) token from tv where not exists (select 1 from gw where gw.match_id = tv.match_id and gw.word = lower(tv.t))),
pr as (select distinct token, word from fresh join gw using (match_id) where abs(length(token) - length(word)) <= 4 and 200.0 * least(length(token), length(word)) >= 75 * (length(token) + length(word))),
rt as (select token, word, {s_indel('token', 'word')} r from pr), near as (select match_id, token, max(r) score from fresh join gw using (match_id) join rt using (token, word) where r >= 75 group by all)"""


def spoken(spark, sf_dir):
    return segments(spark, sf_dir).where("text is not null").select("match_id", "seg_key", "text")


@query("ref_j3_nearest_words", f"with {MIS} select match_id, token, round(score, 6) as score from near")
def j3(spark, sf_dir):
    df = spoken(spark, sf_dir)
    w = df.select("match_id", F.explode(T.words(F.col("text"))).alias("w")).select("match_id", T.strip_chars(F.col("w"), ".,!?;:'\"()-—–…").alias("t"))
    tokens = w.where((F.length("t") >= 5) & F.col("t").rlike(r"^[\p{L}'\-]+$") & F.col("t").rlike(r"\p{L}")).select("match_id", F.lower("t").alias("token"))
    return N.nearest_words(tokens, N.gazetteer_words(gazetteer(spark, sf_dir))).select("match_id", "token", F.round("score", 6).alias("score"))


@query("ref_m4_misheard", f"with {MIS} select seg_key, t as text, count(*) as n from tv join near on tv.match_id = near.match_id and lower(tv.t) = near.token group by all")
def m4(spark, sf_dir):
    out = N.misheard_spans(spoken(spark, sf_dir), ["seg_key"], "text", N.gazetteer_words(gazetteer(spark, sf_dir)))
    return out.groupBy("seg_key", "text").agg(F.count("*").alias("n"))


DICTIONARY = f"dict as (select w as word from (select unnest({s_words('text')}) w from seg where text is not null) where regexp_full_match(w, '\\p{{Ll}}+') group by w having count(*) >= 20)"


def dictionary(spark, sf_dir):
    """Words often written in small letters: a dictionary made of the transcripts themselves."""
    w = segments(spark, sf_dir).where("text is not null").select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.where(F.col("word").rlike(r"^\p{Ll}+$")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 20").select("word")


@query("ref_p11_dictionary_word", f"with {SEG}, {DICTIONARY} select entity_id, lower(text) in (select word from dict) as real_word from entities where text is not null")
def p11(spark, sf_dir):
    return M.real_words(table(spark, sf_dir, "entities").where("text is not null").select("entity_id", "text"), "text", dictionary(spark, sf_dir)).select("entity_id", "real_word")


@query("ref_m2_short_segment_names", f"with {SEG} select seg_key, w as text from (select seg_key, unnest({S_CAPITALISED.format(S_BOUND.format('text'))}) w from seg where text is not null and len({s_words('text')}) <= 3) where length(w) >= 3")
def m2_names(spark, sf_dir):
    """Every word the operator finds (brute force in the tests as well)."""
    return N.short_segment_names(segments(spark, sf_dir).where("text is not null"), ["seg_key"], "text")


@query(
    "ref_m3_capital_spans",
    f"""with {SEG}, w as (select seg_key, text, unnest({s_words('text')}) w, generate_subscripts({s_words('text')}, 1) i from seg where text is not null), b as (select seg_key, i, trim(w, '.,!?;:''"') t from w)
select seg_key, t as text, count(*) as n from b where length(t) >= 3 and regexp_matches(t, '^\\p{{Lu}}') and i > 1 group by all""",
)
def m3(spark, sf_dir):
    return N.capital_spans(segments(spark, sf_dir).where("text is not null"), ["seg_key"], "text").groupBy("seg_key", "text").agg(F.count("*").alias("n"))


@query(
    "ref_m3_span_offsets",
    f"""with {SEG}, p as (select seg_key, regexp_extract_all(text, '({W}*[^{W[1:]}+)', 1) ps from seg where text is not null),
w as (select seg_key, i, {s_strip('ps[i]')} w, list_sum(list_transform(ps[:i], lambda x: length(x))) - length({s_strip('ps[i]')}) off from p, lateral (select unnest(range(1, len(ps) + 1)) i)),
b as (select seg_key, i, trim(w, '.,!?;:''"') t, off + length(w) - length(ltrim(w, '.,!?;:''"')) s from w)
select seg_key, t as text, s::bigint as start_char, (s + length(t))::bigint as end_char from b where length(t) >= 3 and regexp_matches(t, '^\\p{{Lu}}') and i > 1""",
)
def m3_offsets(spark, sf_dir):
    """Where the spans stand."""
    return N.capital_spans(segments(spark, sf_dir).where("text is not null"), ["seg_key"], "text").select("seg_key", "text", F.col("start_char").cast("long"), F.col("end_char").cast("long"))


@query(
    "ref_p13_pos_at_offset",
    """select e.entity_id, x.pos from (select distinct on (entity_id) * from entities where start_char is not null) e,
lateral (select coalesce(arg_min(o.pos, o.entity_id), '') pos from (select distinct on (entity_id) * from entities where pos is not null and start_char is not null and end_char is not null) o where o.match_id = e.match_id and o.feed = e.feed and o.half = e.half and o.segment_id = e.segment_id and o.start_char <= e.start_char and e.start_char < o.end_char) x""",
)
def p13(spark, sf_dir):
    """The tag of the token (here: of the tagged spans) that covers an offset, '' if none."""
    e = table(spark, sf_dir, "entities").dropDuplicates(["entity_id"])
    tags = e.where("pos is not null and start_char is not null and end_char is not null").groupBy(*HALF, "segment_id").agg(F.sort_array(F.collect_list(F.struct("entity_id", "pos", F.col("start_char").alias("start"), F.col("end_char").alias("end")))).alias("t"))
    return e.where("start_char is not null").join(tags, [*HALF, "segment_id"], "left").select("entity_id", M.tags_at(F.col("t"), F.col("start_char")).alias("pos"))


@query(
    "ref_p13_pos_by_word",
    f"with recursive {SEG}, {HEARD} select seg_key, array_to_string(list_transform(places, lambda p: case when p = 0 then '' when regexp_matches(hs[p], '^\\p{{Lu}}') then 'PROPN' else 'X' end), ',') as tags from wp join wt using (seg_key)",
)
def p13_by_word(spark, sf_dir):
    """Tags of a text's words, the tagged words being the recogniser's (PROPN where one begins with a capital)."""
    s = segments(spark, sf_dir).where("text is not null and size(words) > 0")
    bare = F.transform("words", lambda w: T.strip_chars(F.coalesce(w["word"], F.lit("")), " .,!?;:"))
    s = s.select("seg_key", T.words(F.col("text")).alias("w"), bare.alias("h")).where("size(w) > 0")
    tags = F.transform("h", lambda x: F.when(x.rlike(r"^\p{Lu}"), "PROPN").otherwise("X"))
    return s.select("seg_key", F.array_join(M.tags_of_words(F.col("w"), F.col("h"), tags), ",").alias("tags"))


@query(
    "ref_j11_overlap_suppress",
    """with e as (select distinct on (entity_id) * from entities where start_char is not null and end_char is not null) select h.entity_id from e h where h.source <> 'spacy'
and not exists (select 1 from e s where s.source = 'spacy' and s.match_id = h.match_id and s.feed = h.feed and s.half = h.half and s.segment_id = h.segment_id and h.start_char < s.end_char and h.end_char > s.start_char)""",
)
def j11(spark, sf_dir):
    e = table(spark, sf_dir, "entities").where("start_char is not null and end_char is not null").dropDuplicates(["entity_id"])
    return M.without_overlaps(e.where("source <> 'spacy'"), e.where("source = 'spacy'"), [*HALF, "segment_id"], "start_char", "end_char").select("entity_id")


@query(
    "ref_m6_entities",
    """with l as (select match_id, coalesce(lang, 'en') lang from match_data left join leagues using (league)),
e as (select distinct on (entity_id) e.*, l.lang from entities e left join l using (match_id) where start_char is not null and end_char is not null),
m as (select * from e where source = 'spacy' and list_contains(case when lang = 'en' then ['PERSON', 'ORG', 'GPE', 'FAC'] else ['PER', 'ORG', 'LOC', 'MISC'] end, label))
select entity_id, source from m union all select entity_id, source from e h where source <> 'spacy'
and not exists (select 1 from m s where s.match_id = h.match_id and s.feed = h.feed and s.half = h.half and s.segment_id = h.segment_id and h.start_char < s.end_char and h.end_char > s.start_char)""",
)
def m6(spark, sf_dir):
    """The model's names by the labels of the match's language, and the heuristic ones beside them."""
    languages = table(spark, sf_dir, "match_data").join(table(spark, sf_dir, "leagues").select("league", "lang"), "league", "left").select("match_id", F.coalesce("lang", F.lit("en")).alias("lang"))
    e = table(spark, sf_dir, "entities").where("start_char is not null and end_char is not null").dropDuplicates(["entity_id"]).join(languages, "match_id", "left")
    out = M.combined_spans(e.where("source = 'spacy'"), e.where("source <> 'spacy'"), [*HALF, "segment_id"], "start_char", "end_char", "label", F.col("lang"))
    return out.select("entity_id", "source")


@query("ref_j10_not_canonical", f"with {GAZ}, e as (select distinct on (entity_id) * from entities where text is not null) select entity_id from e where not exists (select 1 from gaz where gaz.match_id = e.match_id and lower(gaz.variant) = lower(e.text))")
def j10(spark, sf_dir):
    e = table(spark, sf_dir, "entities").where("text is not null").dropDuplicates(["entity_id"]).select("entity_id", "match_id", F.lower("text").alias("v"))
    return e.join(gazetteer(spark, sf_dir).select("match_id", F.lower("variant").alias("v")).distinct(), ["match_id", "v"], "left_anti").select("entity_id")


def s_grams(x: str) -> str:
    p = "(' ' || w || ' ')"
    of = lambda n: f"list_transform(range(1, greatest(length({p}) - {n} + 2, 2)), lambda i: substring({p}, i::int, {n}))"
    return f"flatten(list_transform({s_words(f'lower({x})')}, lambda w: list_concat(list_concat({of(2)}, {of(3)}), case when length({p}) <= 3 then [] else {of(4)} end)))"


COS = f"""{GAZ}, q as (select distinct match_id, @@ query from entities where text is not null and length(@@) > 2), c as (select distinct match_id, canonical from gaz), n as (select match_id, count(*) n from c group by 1),
cg as (select match_id, canonical, g, count(*) tf from (select match_id, canonical, unnest({s_grams('canonical')}) g from c) group by all), idf as (select match_id, g, ln((1 + n)::double / (1 + df)) + 1 idf from (select match_id, g, count(*) df from cg group by all) join n using (match_id)),
cw as (select match_id, canonical, g, tf * idf cw from cg join idf using (match_id, g)), cn as (select match_id, canonical, sqrt(sum(cw * cw)) cn from cw group by all),
qw as (select match_id, query, g, count(*) * any_value(idf) qw from (select match_id, query, unnest({s_grams('query')}) g from q) join idf using (match_id, g) group by all), qn as (select match_id, query, sqrt(sum(qw * qw)) qn from qw group by all),
cos as (select match_id, query, canonical, sum(qw * cw) / any_value(qn) / any_value(cn) cos from qw join cw using (match_id, g) join qn using (match_id, query) join cn using (match_id, canonical) group by all)"""
RET = f"""{COS},
wd as (select match_id, canonical, unnest({s_words('lower(canonical)')}) w from c), nr as (select match_id, query, canonical, w from q join wd using (match_id) where 200.0 * least(length(query), length(w)) >= 65 * (length(query) + length(w))),
rr as (select query, w, {s_indel('lower(query)', 'w')} r from (select distinct query, w from nr)), bs as (select match_id, query, canonical, max(r) r from nr join rr using (query, w) where r >= 65 group by all),
sc as (select match_id, query, canonical, case when r is not null then greatest(coalesce(cos, 0), least(r / 100, 0.9 - 1e-6)) else cos end score from cos full join bs using (match_id, query, canonical)),
top as (select *, row_number() over (partition by match_id, query order by round(score, 9) desc, canonical) n from sc where score > 0)"""
CORE = f"ltrim(regexp_replace((case when lower(rtrim({s_strip('text')}, '.,!?;:')) like '% and co' then left(rtrim({s_strip('text')}, '.,!?;:'), -7) else rtrim({s_strip('text')}, '.,!?;:') end), '[''’]s$', ''), '.,!?;:')"


@query("ref_j4_retrieve", f"with {RET.replace(chr(64) * 2, CORE)} select match_id, query, canonical, round(score, 6) as score, n from top where n <= 5")
def j4(spark, sf_dir):
    q = table(spark, sf_dir, "entities").where("text is not null").select("match_id", T.entity_core(F.col("text")).alias("query")).where(F.length("query") > 2)
    return N.retrieve(q, gazetteer(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "ref_f16_reduce",
    f"""with p as (select distinct original, corrected from corrections where original is not null and corrected is not null),
w as (select original, corrected, unnest({s_words('corrected')}) w, generate_subscripts({s_words('corrected')}, 1) i from p where not contains(original, ' ') and contains(corrected, ' ')),
b as (select original, corrected, arg_max(w, {s_indel('lower(original)', 'lower(w)')} * 1000 - i) w from w group by all)
select original, corrected, coalesce(w, corrected) as word from p left join b using (original, corrected)""",
)
def f16(spark, sf_dir):
    pairs = table(spark, sf_dir, "corrections").where("original is not null and corrected is not null").select("original", "corrected").distinct()
    return N.reduce_to_word(pairs, "original", "corrected", "word")


@query(
    "ref_f15_gates",
    f"""with c as (select *, {s_indel('lower(original)', 'lower(corrected)')} r from corrections where original is not null and corrected is not null)
select correction_id, length(original) > 0 and length(corrected) > 0 and (lower({s_strip('original')}) = lower({s_strip('corrected')}) or (r >= 60 and not (r < 75 and length(trim(original, ' .,!?;:''"()-')) >= 4 and lower(trim(original, ' .,!?;:''"()-')) in ('premier', 'sunday', 'with', 'after'))
 and abs(length(corrected) - length(original)) <= greatest(2, floor(length(original) * 0.6 + 1e-9)))) as passes from c""",
)
def f15(spark, sf_dir):
    c = table(spark, sf_dir, "corrections").where("original is not null and corrected is not null")
    real = F.lower(T.strip_chars(F.col("original"), T.EDGE_PUNCT)).isin("premier", "sunday", "with", "after")
    return c.select("correction_id", N.gate(F.col("original"), F.col("corrected"), indel_ratio(F.lower("original"), F.lower("corrected")), real).alias("passes"))


def first_choice(rows):
    """A judge that picks the first candidate: stands for the injected model."""
    return rows["entity"].map(lambda _: "A")


def cascade(spark, sf_dir):
    # a flag, as with the text itself all steps that need none would carry it
    said = table(spark, sf_dir, "segments").withColumn("__said", F.col("text").isNotNull()).dropDuplicates([*HALF, "segment_id"]).where("__said")
    seg = said.select("match_id", "half", F.concat_ws(":", "feed", "segment_id").alias("segment_id"), F.row_number().over(Window.partitionBy("match_id", "half").orderBy("feed", "start_time", "ord", "segment_id")).alias("ord"), "text")
    spans = table(spark, sf_dir, "entities").where("text is not null and start_char is not null and end_char > start_char").dropDuplicates(["entity_id"]).select("match_id", "half", F.concat_ws(":", "feed", "segment_id").alias("segment_id"), "text", "start_char", "end_char")
    return N.correct_entities(seg, spans, gazetteer(spark, sf_dir), judge=first_choice)


S_GATE = f"length(entity) > 0 and length(word) > 0 and (lower({s_strip('entity')}) = lower({s_strip('word')}) or (word_ratio >= 60 and abs(length(word) - length(entity)) <= greatest(2, floor(length(entity) * 0.6 + 1e-9))))"
# the cascade without a cache, the judge taking the first candidate
CASCADE = f"""{SEG}, sg as (select match_id, half, concat_ws(':', feed, segment_id) sid, row_number() over (partition by match_id, half order by feed, start_time, ord, segment_id) ord, text from seg where text is not null),
sp as (select match_id, half, concat_ws(':', feed, segment_id) sid, {CORE} entity, start_char from (select distinct on (entity_id) * from entities where text is not null and start_char is not null and end_char > start_char)),
pl as (select sp.*, lower(entity) as key, ord from sp join sg using (match_id, half, sid) where length({s_strip('entity')}) > 2),
fi as (select match_id, key, arg_min(entity, {{'h': half, 'o': ord, 's': -start_char}}) entity, min({{'h': half, 'o': ord, 's': -start_char}}) earliest from pl group by all),
{RET.replace('select distinct match_id, @@ query from entities where text is not null and length(@@) > 2', 'select distinct match_id, entity query from fi')},
fq as (select match_id, lower(trim(w, ' .,!?;:''"()-')) as key, count(*) freq from (select match_id, unnest({s_words('text')}) w from sg) group by all),
b1 as (select fi.*, t1.canonical best, t1.score, t1.score - coalesce(t2.score, 0) gap, coalesce(freq, 0) freq from fi left join top t1 on t1.match_id = fi.match_id and t1.query = fi.entity and t1.n = 1 left join top t2 on t2.match_id = fi.match_id and t2.query = fi.entity and t2.n = 2 left join fq on fq.match_id = fi.match_id and fq.key = fi.key),
wr as (select distinct entity, best, unnest({s_words('best')}) w, generate_subscripts({s_words('best')}, 1) i from b1 where not contains(entity, ' ') and contains(best, ' ')),
ww as (select entity, best, arg_max(w, {s_indel('lower(entity)', 'lower(w)')} * 1000 - i) w from wr group by all),
b2 as (select b1.*, coalesce(w, best) word from b1 left join ww using (entity, best)), b3 as (select *, {s_indel('lower(entity)', 'lower(word)')} word_ratio from b2),
b4 as (select *, case when best is null then 'auto_reject_low' when lower(best) = key then 'self_match' when freq >= 5 then 'auto_reject_freq_heuristic' when score < 0.40 then 'auto_reject_low'
  when score >= 0.90 and gap >= 0.10 then case when {S_GATE} then 'auto_accept_shortcut' else 'auto_reject_dict_veto' end
  when length({s_strip('entity')}) < 5 and word_ratio < 85 then 'auto_reject_low' when word_ratio < 65 then 'auto_reject_low' when {S_GATE} then 'mcq_chose_candidate' else 'auto_reject_dict_veto' end code,
  best is not null and lower(best) <> key and freq < 5 and score >= 0.40 and not (score >= 0.90 and gap >= 0.10) and not (length({s_strip('entity')}) < 5 and word_ratio < 85) and word_ratio >= 65 asked from b3),
dec as (select match_id, key, code, case when code in ('auto_accept_shortcut', 'mcq_chose_candidate') then word end applied, case code when 'auto_accept_shortcut' then 'tfidf_shortcut' when 'mcq_chose_candidate' then 'mcq_judge' end as method, score * 100 score, case when asked then 'A' end choice, case when asked or code = 'auto_accept_shortcut' then word_ratio end ratio, earliest from b4)"""


@query("ref_m7_decisions", f"with {CASCADE} select match_id, key, code, applied, method, round(score, 5) as score, choice, round(ratio, 5) as ratio from dec")
def m7(spark, sf_dir):
    """How the cascade ends for each distinct name of a match; the judge is injected, here one that takes the first candidate."""
    return cascade(spark, sf_dir)[0].withColumns({"score": F.round("score", 5), "ratio": F.round("ratio", 5)})


@query(
    "ref_m7_corrections",
    f"""with {CASCADE}, h as (select pl.*, applied, method, score, choice, ratio, {{'h': half, 'o': ord, 's': -start_char}} <> earliest again from pl join dec using (match_id, key) where applied is not null)
select match_id, half, sid as segment_id, entity as original, applied as corrected, case when again then 100.0 else round(score, 1) end as score, case when again and ratio >= 75 then 'validated_cache' when again then 'per_match_cache' else method end as method,
case when not again then choice end as judge_choice, entity <> applied as changed from h""",
)
def m7_corrections(spark, sf_dir):
    """The corrections it makes, one for each span."""
    return cascade(spark, sf_dir)[1]


@query(
    "ref_a24_telemetry",
    f"""with {CASCADE}, r as (select *, row_number() over (partition by code order by match_id, key) k from dec), e as (select code, count(*) n, list(key order by match_id, key) filter (k <= 5) x from r group by 1)
select code, n, array_to_string(x, '|') as examples, code || '=' || n || ' [' || array_to_string(x, ', ') || ']' as line from e""",
)
def a24(spark, sf_dir):
    """Distinct names by how the cascade ended for them."""
    return M.telemetry(cascade(spark, sf_dir)[0], "code", "key", ["match_id", "key"]).withColumn("examples", F.array_join("examples", "|"))


@query(
    "ref_a24_method_telemetry",
    """with c as (select distinct on (correction_id) * from corrections where method is not null), r as (select *, row_number() over (partition by method order by correction_id) k from c)
select method, count(*) as n, array_to_string(list(coalesce(original, 'NULL') order by correction_id) filter (k <= 5), ', ') as examples, method || '=' || count(*) || ' [' || array_to_string(list(coalesce(original, 'NULL') order by correction_id) filter (k <= 5), ', ') || ']' as line from r group by 1""",
)
def a24_methods(spark, sf_dir):
    """[A24] Corrections by method, with examples and the formatted line."""
    c = table(spark, sf_dir, "corrections").where("method is not null").dropDuplicates(["correction_id"]).withColumn("original", F.coalesce("original", F.lit("NULL")))
    return M.telemetry(c, "method", "original", ["correction_id"]).withColumn("examples", F.array_join("examples", ", "))


NAMED = "(select distinct match_id, canonical from gaz where length(canonical) >= 4)"
S_KEYED = "lower(trim(regexp_replace({}, '[^\\p{{L}} ]', '', 'g')))"


def s_variants(texts: str, p: str) -> str:
    """CTEs ``<p>v``: match_id, canonical, variant, uses over the texts (match_id, id, text)."""
    return f"""{p}w as (select match_id, id, unnest({s_words('text')}) w, generate_subscripts({s_words('text')}, 1) i from {texts} where text is not null),
{p}f as (select match_id, 1 k, w form from {p}w union all select match_id, 2, w || ' ' || nx from (select *, lead(w) over (partition by id order by i) nx from {p}w) where nx is not null),
{p}u as (select match_id, k, {S_KEYED.format('form')} variant, count(*) uses from {p}f where regexp_matches(form, '^\\p{{Lu}}') group by all),
{p}n as (select distinct match_id, canonical, len({s_words('canonical')}) k, {S_KEYED.format('canonical')} key from {NAMED}),
{p}p as (select u.match_id, canonical, variant, key, uses from {p}u u join {p}n n using (match_id, k) where variant <> '' and key <> '' and k <= 2 and abs(length(variant) - length(key)) <= k + 3 and 200.0 * least(length(variant), length(key)) >= 70 * (length(variant) + length(key))),
{p}r as (select variant, key, {s_indel('variant', 'key')} r from (select distinct variant, key from {p}p)), {p}v as (select match_id, canonical, variant, uses from {p}p join {p}r using (variant, key) where r >= 70)"""


# a text with its corrections of names put in, one after the other
FIXED = """fx as (select match_id, feed, half, segment_id, list([original, corrected] order by correction_id) l from (select distinct on (correction_id) * from corrections where stage = 'entity' and original <> '' and corrected <> '') group by all),
fixed as (select match_id, seg_key id, seg_key, text as before, case when l is null then text else list_reduce(l, lambda acc, x: [replace(acc[1], x[1], x[2])], [text])[1] end text from seg left join fx using (match_id, feed, half, segment_id))"""


def corrected_texts(spark, sf_dir):
    """match_id, seg_key, before, text: the texts, and what the listed corrections of names make of them."""
    c = table(spark, sf_dir, "corrections").where("stage = 'entity' and original <> '' and corrected <> ''").dropDuplicates(["correction_id"])
    listed = c.groupBy(*HALF, "segment_id").agg(F.sort_array(F.collect_list(F.struct("correction_id", "original", "corrected"))).alias("l"))
    s = segments(spark, sf_dir).select(*HALF, "segment_id", "seg_key", "text").join(listed, [*HALF, "segment_id"], "left")
    done = F.when(F.col("l").isNull(), F.col("text")).otherwise(F.aggregate("l", F.col("text"), lambda acc, x: F.replace(acc, x["original"], x["corrected"])))
    return s.select("match_id", "seg_key", F.col("text").alias("before"), done.alias("text"))


def canonicals(spark, sf_dir):
    return gazetteer(spark, sf_dir).where("length(canonical) >= 4").select("match_id", "canonical").distinct()


@query("ref_a7_surface_variants", f"with {SEG}, {GAZ}, t as (select match_id, seg_key id, text from seg), {s_variants('t', 'a')} select match_id, canonical, variant, uses::bigint as uses from av")
def a7(spark, sf_dir):
    """Writings near each name of the match's list, in one word or two."""
    return M.surface_variants(segments(spark, sf_dir).select("match_id", "text"), canonicals(spark, sf_dir), ["match_id"], "text")


DELTA = f"""{SEG}, {GAZ}, {FIXED}, t as (select match_id, seg_key id, text from seg), {s_variants('t', 'a')}, {s_variants('fixed', 'z')},
dr as (select match_id, canonical, count(distinct variant) n, sum(uses) u from av group by all), dc as (select match_id, canonical, count(distinct variant) n, sum(uses) u from zv group by all),
delta as (select match_id, canonical, coalesce(dr.n, 0) raw_variants, coalesce(dr.u, 0)::bigint raw_uses, coalesce(dc.n, 0) cleaned_variants, coalesce(dc.u, 0)::bigint cleaned_uses, coalesce(dc.n, 0) - coalesce(dr.n, 0) as delta from dr full join dc using (match_id, canonical))"""


def delta(spark, sf_dir):
    texts, names_ = corrected_texts(spark, sf_dir), canonicals(spark, sf_dir)
    sides = [M.surface_variants(texts.select("match_id", F.col(c).alias("text")), names_, ["match_id"], "text") for c in ("before", "text")]
    return M.variant_delta(*sides, ["match_id"])


@query("ref_a8_variant_delta", f"with {DELTA} select *, case when delta < 0 then 'collapsed' when delta > 0 then 'expanded' else '' end as mark from delta")
def a8(spark, sf_dir):
    """Writings of each name before and after the corrections of names."""
    return delta(spark, sf_dir)


@query("ref_t8_top_drops", f"with {DELTA} select match_id, canonical, delta from delta order by delta, match_id, canonical limit 15")
def t8(spark, sf_dir):
    return M.top_drops(delta(spark, sf_dir), ["match_id"]).select("match_id", "canonical", "delta")


@query("ref_a8_cleaned_delta")
def a8_cleaned(spark, sf_dir):
    """No SQL, as of the whole cleaning.  Writings of each name before and after it."""
    raw = with_language(spark, sf_dir)
    names_ = canonicals(spark, sf_dir)
    after, _ = C.clean(raw)
    return M.variant_delta(*[M.surface_variants(t.select("match_id", "text"), names_, ["match_id"], "text") for t in (raw, after)], ["match_id"])


@query("ref_j12_changed", f"with {SEG}, {FIXED} select seg_key, before, text as after from fixed where text is distinct from before")
def j12(spark, sf_dir):
    """Texts the corrections of names changed."""
    t = corrected_texts(spark, sf_dir)
    return M.changed_rows(segments(spark, sf_dir).select("seg_key", "text"), t, ["seg_key"], "text")


TOKEN = "trim(text, '.,;:!?\"''()[]{}')"
REFUSED = f"""{SEG}, {DICTIONARY}, {COS.replace('select distinct match_id, @@ query from entities where text is not null and length(@@) > 2', f"select match_id, min({TOKEN}) query from entities where text is not null and {TOKEN} <> '' and not exists (select 1 from gaz where gaz.match_id = entities.match_id and lower(gaz.canonical) = lower({TOKEN})) group by match_id, lower({TOKEN})")},
top as (select *, row_number() over (partition by match_id, query order by round(cos, 9) desc, canonical) k from cos where cos > 0),
fr as (select match_id, lower(trim(w, '.,;:!?"''()[]{{}}')) token, count(*) n from (select match_id, unnest({s_words('text')}) w from seg where text is not null) group by all),
ac as (select distinct match_id, lower(original) o, lower(corrected) k from corrections where stage = 'entity' and original is not null and corrected is not null),
rb as (select t.match_id, t.query token, t.canonical best, cos, coalesce(n, 0) freq, lower(t.query) in (select word from dict) real_word from top t left join fr on fr.match_id = t.match_id and fr.token = lower(t.query)
  where k = 1 and not exists (select 1 from ac where ac.match_id = t.match_id and ac.o = lower(t.query) and ac.k = lower(t.canonical))),
rf as (select *, {s_indel('token', 'best')} fuzz from rb),
refused as (select *, case when freq >= 5 then 'frequency_heuristic' when cos < 0.40 then 'shortcut_reject_low_cosine' when length(token) < 5 and fuzz < 85 then 'mcq_pregate_short_low_fuzz' when fuzz < 65 then 'mcq_pregate_low_fuzz'
  when abs(length(token) - length(best)) > greatest(2.0, 0.6 * length(token)) then 'validation_c2_length_tolerance' when fuzz < 75 and length(trim(token, ' .,!?;:''"()-')) >= 4 and real_word then 'validation_dict_veto' end bucket from rf)"""


def refused(spark, sf_dir):
    accepted = table(spark, sf_dir, "corrections").where("stage = 'entity' and original is not null and corrected is not null")
    found = table(spark, sf_dir, "entities").select("match_id", "text")
    return M.refused_candidates(found, segments(spark, sf_dir).select("match_id", "text"), gazetteer(spark, sf_dir).select("match_id", "canonical"), accepted, dictionary(spark, sf_dir))


@query("ref_m11_refused", f"with {REFUSED} select match_id, token, best, round(cos, 6) as cosine, round(fuzz, 6) as fuzz, freq, bucket from refused where bucket is not null")
def m11(spark, sf_dir):
    """Why found names were not corrected."""
    return refused(spark, sf_dir).withColumns({"cosine": F.round("cosine", 6), "fuzz": F.round("fuzz", 6)})


@query("ref_m11_buckets", f"with {REFUSED} select bucket, count(*) as n from refused where bucket is not null group by 1")
def m11_buckets(spark, sf_dir):
    return refused(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


def asked_names(spark, sf_dir):
    """Queries of one name each of the first names of the gazetteer in order, and of no name."""
    g = table(spark, sf_dir, "gazetteer")
    return g.select(F.col("ref_id").cast("string").alias("qid"), F.concat(F.lit("shot by "), F.element_at(T.words(F.col("canonical")), -1)).alias("query"))


S_WIDE = f"""{SEG}, {GAZ}, t as (select match_id, seg_key id, text from seg), {s_variants('t', 'a')},
qs as (select ref_id::varchar qid, 'shot by ' || {s_words('canonical')}[-1] query from gazetteer), qw as (select distinct qid, unnest({s_words('lower(query)')}) w from qs),
nf as (select distinct canonical, w from (select canonical, unnest(list_concat({s_words('lower(canonical)')}, {s_words('lower(variant)')})) w from av)),
mt as (select distinct qid, canonical from qw join nf using (w)), mo as (select qid, string_agg(w, ' ' order by w) more from (select distinct qid, w from mt join nf using (canonical) except select qid, w from qw) group by 1),
wide as (select qid, query, case when more is null then query else query || ' ' || more end wider from qs left join mo using (qid))"""


def widened(spark, sf_dir):
    writings = M.surface_variants(segments(spark, sf_dir).select("match_id", "text"), canonicals(spark, sf_dir), ["match_id"], "text")
    return M.expanded_queries(asked_names(spark, sf_dir), cut_lineage(writings.select("canonical", "variant").distinct()))


@query("ref_m16_query_expansion", f"with {S_WIDE} select qid, query, wider from wide")
def m16(spark, sf_dir):
    """A query for each name of the list, widened by the writings the transcripts have of it."""
    return widened(spark, sf_dir)


@query("ref_m16_expanded_search")
def m16_search(spark, sf_dir):
    """No SQL (that of M14 and of the expansion hold for its parts): the search with widened queries."""
    docs = segments(spark, sf_dir).where("text is not null").select("seg_key", "match_id", "text")
    wide = widened(spark, sf_dir).select("qid", F.col("wider").alias("query"))
    return search.lexical_search(docs, wide, "seg_key", "text", "match_id", top=1, fuzzy=False)
