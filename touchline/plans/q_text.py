"""Queries of the predicates and scalar functions, over all segments, names and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions import similarity as S
from touchline.functions import text as T
from touchline.plans.registry import W, query, s_indel, s_strip, s_trim, s_words
from touchline.sources.tables import table


def on(name: str, tab: str, ids: str, columns: dict[str, tuple[Callable[[], Column], str]], where: str = "true") -> None:
    """A projection of every row of a table, and the same in SQL."""
    sql = f"select {ids}, " + ", ".join(f"{e} as {k}" for k, (_, e) in columns.items()) + f" from {tab} where {where}"

    @query(name, sql)
    def run(spark, sf_dir):
        return table(spark, sf_dir, tab).where(where).select(*ids.split(", "), *[c().alias(k) for k, (c, _) in columns.items()])


t = lambda: F.col("text")
TX = "text is not null"
seg = lambda name, **cols: on(name, "segments", "seg_key", cols, TX)
ent = lambda name, **cols: on(name, "entities", "entity_id", cols, TX)
cor = lambda name, **cols: on(name, "corrections", "correction_id", cols, "original is not null and corrected is not null")

# words are told by marks around them, as these expressions have no word bounds
S_BOUND = "regexp_replace({}, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', chr(2) || '\\1' || chr(2), 'g')"


S_CAPITALISED = "list_transform(regexp_extract_all({}, '\\x02([A-ZÅÄÖÆØ][a-zà-ÿ]+(?:\\x02[''-]\\x02[A-Za-zÅÄÖÆØà-ÿ]+)*)\\x02', 1), lambda v: replace(v, chr(2), ''))"

ALPHA = r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]"
S_RATIO = f"(case when length(regexp_replace(text, '{W}', '', 'g')) > 0 then length(regexp_replace(text, '[^A-Za-zªµºÀ-ÖØ-öø-ɏ]', '', 'g'))::double / length(regexp_replace(text, '{W}', '', 'g')) else 0.0 end)"
S_NONLATIN = r"regexp_matches(text, '[\x{400}-\x{4ff}\x{600}-\x{6ff}\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]')"

seg("ref_p1_alpha_ratio", ratio=(lambda: T.alpha_ratio(t()), S_RATIO))
on("ref_p1_alpha_ratio_documents", "documents", "doc_id", {"ratio": (lambda: T.alpha_ratio(t()), S_RATIO)}, TX)
on("ref_p2_non_latin", "documents", "doc_id", {"non_latin": (lambda: T.non_latin(t()), S_NONLATIN)}, TX)
on(
    "ref_p3_removal_reason", "segments", "seg_key",
    {"reason": (
        lambda: F.regexp_replace(T.removal_reason(t()), r" \(.*", ""),
        f"case when {s_strip('coalesce(text, chr(32))')} = '' then 'empty_segment' when {S_NONLATIN} then 'non_latin_characters' when {S_RATIO} < 0.5 then 'low_alpha_ratio' end",
    )},
)
seg(
    "ref_p6_garbage_class",
    kind=(lambda: T.garbage_class(t()), f"""case when len({s_words('text')}) < 3 or length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))::double / length(text) < 0.5
      or len(list_filter(range(1, greatest(len({s_words('text')}) - 1, 1)), lambda i: lower({s_words('text')}[i]) = lower({s_words('text')}[i + 1]) and lower({s_words('text')}[i]) = lower({s_words('text')}[i + 2]))) > 0 then 'garbage'
      when len({s_words('text')}) >= 5 and len(list_filter({s_words('lower(text)')}, lambda v: length(trim(v, '.,;:!?')) > 4 and regexp_matches(trim(v, '.,;:!?'), '(ing|ed|es|s)$'))) > 0 then 'real'
      when len({s_words('text')}) >= 7 then 'real' else 'ambiguous' end"""),
)
seg(
    "ref_p7_capitalised_words",
    found=(lambda: F.size(F.regexp_extract_all(t(), F.lit(r"(?<![\p{L}\p{N}_'-])([A-ZÅÄÖÆØ][a-zà-ÿ]+)(?![\p{L}\p{N}_'-])"), 1)),
           r"len(regexp_extract_all(regexp_replace(regexp_replace(' ' || text || ' ', '([^\p{L}\p{N}_''-]+)', ' \1 ', 'g'), ' ', '  ', 'g'), '[^\p{L}\p{N}_''-]([A-ZÅÄÖÆØ][a-zà-ÿ]+)[^\p{L}\p{N}_''-]', 1))"),
)


@query("ref_p7_all_capitalised_words", f"select seg_key, len({S_CAPITALISED.format(S_BOUND.format('text'))})::int as found from segments where text is not null")
def p7_all(spark, sf_dir):
    """The whole operator (brute force in the tests as well)."""
    return table(spark, sf_dir, "segments").where(TX).select("seg_key", F.size(T.capitalised_words(t())).alias("found"))


on("ref_p10_confidence_band", "corrections", "correction_id", {"band": (lambda: T.confidence_band(F.col("score")), "case when score >= 80 then 'high' when score >= 70 then 'medium' else 'low' end")}, "score is not null and not isnan(score)")
on(
    "ref_p9_target_in_text", "segments", "seg_key",
    {"target": (lambda: T.first_target(t(), F.array(F.lit("penalty"), F.lit("Corner"), F.lit("crossbar"))), "list_filter(['penalty', 'Corner', 'crossbar'], lambda x: contains(lower(text), lower(x)))[1]")}, TX,
)
on(
    "ref_p12_by_language", "leagues", "league",
    {"labels": (lambda: F.array_join(T.by_language(F.col("lang"), T.ENTITY_LABELS), ","), "case when lang = 'en' then 'PERSON,ORG,GPE,FAC' else 'PER,ORG,LOC,MISC' end"),
     "model": (lambda: T.by_language(F.col("lang"), T.ASR_MODELS), "case lang when 'en' then 'Systran/faster-whisper-large-v3' when 'sv' then 'KBLab/kb-whisper-large' when 'no' then 'KBLab/kb-whisper-large' when 'da' then 'KBLab/kb-whisper-large' else 'Systran/faster-whisper-large-v3' end"),
     "rejected": (lambda: F.array_contains(T.by_language(F.col("lang"), T.REJECTED_POS), F.lit("NOUN")), "lang = 'en'")},
)

S_CORE_T = s_strip("text")
seg("ref_f2_dedup_key", key=(lambda: T.dedup_key(t()), s_strip("rtrim(" + s_strip("text") + ", '.,!?;:')")))
FILL = "(?i)([^\\p{L}\\p{N}_])(uh|um|eh|er|ah|hm|hmm|uhm|erm)([^\\p{L}\\p{N}_])"
S_PAD = "regexp_replace(' ' || text || ' ', '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
seg("ref_f3_disfluencies", n=(lambda: F.size(T.disfluencies(t())), f"len(regexp_extract_all({S_PAD}, '{FILL}'))"))


def s_compounds(x: str, language: str) -> str:
    for wrong, right in T.COMPOUNDS[language].items():
        x = f"regexp_replace({x}, '(?i)([^\\p{{L}}\\p{{N}}_]){wrong}([^\\p{{L}}\\p{{N}}_])', '\\1{right}\\2', 'g')"
    return f"substring({x}, 2, length({x}) - 2)"


S_MARKED = "(' ' || text || ' ')"
seg("ref_f4_compounds", en=(lambda: T.merge_compounds(t(), "en"), s_compounds(S_MARKED, "en")), sv=(lambda: T.merge_compounds(t(), "sv"), s_compounds(S_MARKED, "sv")))


def s_squeeze(x: str) -> str:
    for ch in ".!?,;:":
        x = f"regexp_replace({x}, '[{ch}]{{2,}}', '{ch}', 'g')"
    return x


seg("ref_f5_repeated_punct", out=(lambda: T.squeeze_punct(t()), s_squeeze("text")))
seg("ref_f6_whitespace", out=(lambda: T.squeeze_space(t()), s_strip(f"regexp_replace(text, '{W}{{2,}}', ' ', 'g')")))
on("ref_f8_surname", "gazetteer", "ref_id", {"rest": (lambda: T.surname(F.col("canonical")), f"case when len({s_words('canonical')}) <= 1 then {s_strip('canonical')} else array_to_string({s_words('canonical')}[2:], ' ') end")})
three = "concat_ws(' ', canonical, entity_type)"
on(
    "ref_f9_name_variants", "gazetteer", "ref_id",
    {"variants": (lambda: F.array_join(T.name_variants(F.concat_ws(" ", "canonical", "entity_type")), "|"),
                  f"""(select string_agg(v, '|' order by o) from (select {s_words(three)} w) x, lateral (
                     select w[1] || ' ' || w[2] v, 1 o union all select w[1] || ' ' || w[3], 2 union all select w[2] || ' ' || w[3], 3
                     union all select w[1][1] || '. ' || w[3], 4 union all select w[1][1] || '.' || w[2][1] || '. ' || w[3], 5) y)""")},
)
on(
    "ref_f10_venue_name", "match_data", "match_id",
    {"names": (lambda: F.array_join(F.transform("venue", T.venue_name), "|"), f"array_to_string(list_transform(venue, lambda v: {s_strip(f'regexp_replace(v, {chr(39)}{W}*[(].*?[)]{W}*${chr(39)}, {chr(39)}{chr(39)})')}), '|')")},
    "venue is not null",
)
S_T1 = f"rtrim({s_strip('text')}, '.,!?;:')"
S_T2 = f"(case when lower({S_T1}) like '% and co' then left({S_T1}, -7) else {S_T1} end)"
S_T3 = f"regexp_replace({S_T2}, '[''’]s$', '')"
ent("ref_f11_entity_core", core=(lambda: T.entity_core(t()), f"ltrim({S_T3}, '.,!?;:')"))
S_REBUILT = f"""substring({S_T3}, 1, length({S_T3}) - length(ltrim({S_T3}, '.,!?;:'))) || 'Nilsson' ||
 substring({S_T2}, length({S_T3}) + 1) || substring({S_T1}, length({S_T2}) + 1) || substring({s_strip('text')}, length({S_T1}) + 1)"""
ent("ref_f12_rebuild", out=(lambda: T.rebuild_entity(t(), F.lit("Nilsson"), F.lit("en")), S_REBUILT))
S_GEN = f"length(ltrim({S_T3}, '.,!?;:')) >= 4 and ltrim({S_T3}, '.,!?;:') like '%s' and {S_T2} = {S_T3}"
ent("ref_f12_rebuild_genitive", out=(lambda: T.rebuild_entity(t(), F.lit("Guidetti"), F.lit("sv")), S_REBUILT.replace("'Nilsson'", f"(case when {S_GEN} then 'Guidettis' else 'Guidetti' end)")))
ent("ref_f13_nfkd", plain=(lambda: S.nfkd(F.col("text")), "strip_accents(replace(text, chr(160), ' '))"))
on("ref_f13_unaccented", "gazetteer", "ref_id", {"plain": (lambda: T.unaccented(F.regexp_replace("canonical", "[øØ]", "o")), "strip_accents(regexp_replace(canonical, '[øØ]', 'o', 'g'))")})


@query("ref_f14_phonetic")
def phonetic(spark, sf_dir):
    """No SQL: metaphone is a UDF.  Best of soundex and metaphone similarity of both names of a correction, by the match's language."""
    languages = table(spark, sf_dir, "match_data").join(table(spark, sf_dir, "leagues"), "league", "left").select("match_id", F.coalesce("lang", F.lit("en")).alias("lang"))
    df = table(spark, sf_dir, "corrections").where("original is not null and corrected is not null").join(languages, "match_id", "left")
    return S.with_phonetic_score(df, "original", "corrected", F.col("lang")).select("correction_id", "score")


cor("ref_f1_indel_ratio", ratio=(lambda: S.indel_ratio(F.lower("original"), F.lower("corrected")), s_indel("lower(original)", "lower(corrected)")))

mask = lambda: F.transform(T.words(F.col("original")), lambda w: w.rlike(r"^\p{Lu}"))
bare = lambda x: f"lower(trim({x}, ' .,!?;:''\"-—–…'))"
SO, SN = s_words("original"), s_words("corrected")
cor(
    "ref_f19_editable_drift",
    drift=(lambda: T.word_count_changed_or_drift(F.col("original"), F.col("corrected"), mask()),
           f"len({SO}) <> len({SN}) or len(list_filter(range(1, len({SO}) + 1), lambda i: {SO}[i] <> {SN}[i] and {bare(SO + '[i]')} <> {bare(SN + '[i]')} and not regexp_matches({SO}[i], '^\\p{{Lu}}'))) > 0"),
)
cor(
    "ref_f20_length_anomaly",
    anomaly=(lambda: T.length_anomaly(F.col("original"), F.col("corrected")), f"case when len({SO}) = 0 then len({SN}) > 0 else len({SN})::double / len({SO}) < 0.5 or len({SN})::double / len({SO}) > 1.5 end"),
)
seg("ref_f21_prompt_echo", echo=(lambda: T.prompt_echo(F.concat(t(), F.when(F.col("half") == 2, " Output: x").otherwise(""))), "half = 2 or " + " or ".join(f"contains(text, '{m}')" for m in T.ECHO_MARKERS)))
seg("ref_f22_clean_output", out=(lambda: T.clean_output(F.concat(F.lit("Answer - "), F.regexp_replace(t(), r"[\n\"']", ""))), s_strip("regexp_replace(text, '[\\n\"'']', '', 'g')")))
seg("ref_f22_unwrap", out=(lambda: T.unwrap(F.concat(F.lit("<"), t(), F.lit("> end"))), s_strip("case when regexp_matches(text, '^[^<>]+$') then text || ' end' else regexp_replace('<' || text || '> end', '<([^<>]+)>', '\\1', 'g') end")))
S_WER = "array_to_string(" + s_words("translate(lower(text), '" + T.WER_PUNCT.replace("'", "''") + "', '')") + ", ' ')"
seg("ref_f25_wer_normal", out=(lambda: T.wer_normal(t()), S_WER))
seg("ref_f26_wer_normal_alternative", out=(lambda: T.wer_normal_alternative(t()), s_strip(f"regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_'']', ' ', 'g'), '{W}+', ' ', 'g')")))
ent("ref_f27_rstrip_possessive", out=(lambda: T.rstrip_possessive(t()), "rtrim(text, '''s')"))
HMS = lambda: F.date_format(F.col("loaded_at"), "HH:mm:ss")
on("ref_f28_hms_seconds", "segments", "seg_key", {"s": (lambda: T.hms_seconds(HMS()), "(hour(loaded_at) * 3600 + minute(loaded_at) * 60 + second(loaded_at))::double"), "ms": (lambda: T.hms_seconds(F.date_format("loaded_at", "mm:ss")), "(minute(loaded_at) * 60 + second(loaded_at))::double")}, "loaded_at is not null")
on("ref_f29_seek_offset", "segments", "seg_key", {"at": (lambda: T.seek_offset(F.col("half"), F.col("start_time"), F.when(F.col("feed") == "stock", 2700.0)), "case when half = 2 then start_time + coalesce(case when feed = 'stock' then 2700.0 end, 0.0) else start_time end")})
on("ref_f30_clip_title", "segments", "seg_key", {"title": (lambda: T.clip_title(F.floor(F.col("start_time") / 60), F.col("half")), "'~' || floor(start_time / 60)::bigint || ''' — ' || case when half = 1 then '1st half' else '2nd half' end"), "clock": (lambda: T.clock(F.col("start_time")), "(floor(start_time)::bigint // 60)::varchar || ':' || lpad((floor(start_time)::bigint % 60)::varchar, 2, '0')")}, "start_time is not null")
S_MATCH = "concat_ws('_', league, season, translate(match_name, ' /', '__'))"
on("ref_f31_ids", "segments", "seg_key", {"match_key": (lambda: T.match_key(F.col("league"), F.col("season"), F.col("match_name")), S_MATCH), "gid": (lambda: T.global_id(F.col("match_id"), F.col("half"), F.col("segment_id")), "match_id || '__h' || half || '__s' || segment_id")})
ent("ref_f32_letters_key", key=(lambda: T.letters_key(t()), "lower(" + s_strip("regexp_replace(text, '[^\\p{L} ]', '', 'g')") + ")"))
seg(
    "ref_f33_loop_and_verb",
    loop=(lambda: T.has_loop(t()), f"len({s_words('text')}) >= 3 and len(list_filter(range(1, greatest(len({s_words('text')}) - 1, 1)), lambda i: lower({s_words('text')}[i]) = lower({s_words('text')}[i + 1]) and lower({s_words('text')}[i]) = lower({s_words('text')}[i + 2]))) > 0"),
    verb=(lambda: T.has_verb_like(t()), f"len(list_filter({s_words('lower(text)')}, lambda v: length(trim(v, '.,;:!?')) > 4 and regexp_matches(trim(v, '.,;:!?'), '(ing|ed|es|s)$'))) > 0"),
)
S_LB = "case when length(v) % 5 = 0 then '.' when length(v) % 7 = 0 then ',' else '' end"
def s_normal(x: str, language: str) -> str:
    """The whole normalisation: hesitations out, compounds merged, stops and spaces squeezed."""
    bare = f"regexp_replace(regexp_replace({S_BOUND.format(x)}, '(?i)\\x02({'|'.join(T.DISFLUENCIES)})\\x02', '', 'g'), '\\x02', '', 'g')"

    def merged(code: str) -> str:
        out = bare
        for wrong, right in T.COMPOUNDS[code].items():
            marked = "\\x02 \\x02".join(wrong.split(" "))
            out = f"regexp_replace(regexp_replace({S_BOUND.format(out)}, '(?i)\\x02{marked}\\x02', '{right}', 'g'), '\\x02', '', 'g')"
        return out

    cases = " ".join(f"when '{c}' then {merged(c)}" for c in T.COMPOUNDS)
    return s_strip(f"regexp_replace({s_squeeze(f'(case {language} {cases} else {bare} end)')}, '{W}{{2,}}', ' ', 'g')")


LB = lambda: F.transform(T.words(t()), lambda w: F.when(F.length(w) % 5 == 0, ".").when(F.length(w) % 7 == 0, ",").otherwise(""))


def s_restored(label: str) -> str:
    """The text with a label (of word v) behind each word without a stop, and capitals at sentence starts."""
    stop = "regexp_matches({0}, '[.,?!:;-]$')"
    mark = f"case when {label} <> '' and not {stop.format('v')} then {label} else '' end"
    ends = f"list_transform({s_words('text')}, lambda v: case when {mark} <> '' then {mark} in ('.', '?') else regexp_matches(v, '[.?!]$') end)"
    said = f"list_transform({s_words('text')}, lambda v: v || {mark})"
    joined = f"array_to_string(list_transform(range(1, len({s_words('text')}) + 1), lambda i: case when i = 1 or ({ends})[i - 1] then upper(({said})[i][1]) || ({said})[i][2:] else ({said})[i] end), ' ')"
    return f"case when len({s_words('text')}) = 0 then {s_strip('text')} else regexp_replace({joined}, '{W}+([.,?!:;])', '\\1', 'g') end"


@query("ref_f24_restore_punctuation", f"select seg_key, {s_restored(S_LB)} as out from segments where text is not null")
def restore(spark, sf_dir):
    """The labels come from a fixed rule here in place of a model."""
    return table(spark, sf_dir, "segments").where(TX).select("seg_key", T.restore_punctuation(t(), LB()).alias("out"))


S_W3 = f"""case when len({s_words('text')}) < 3 then text else array_to_string(list_transform(list_filter(range(1, len({s_words('text')}) + 1), lambda i:
      not coalesce(lower({s_words('text')}[i]) = lower({s_words('text')}[i - 1]) and i > 1, false)
      or (i > 1 and not coalesce(i > 2 and lower({s_words('text')}[i]) = lower({s_words('text')}[i - 2]) and lower({s_words('text')}[i - 1]) = lower({s_words('text')}[i - 2]), false) and not coalesce(lower({s_words('text')}[i]) = lower({s_words('text')}[i + 1]), false))), lambda i: {s_words('text')}[i]), ' ') end"""
seg(
    "ref_w3_collapse_repeats",
    out=(lambda: T.collapse_repeats(t()), S_W3),
)
