"""Scalar text functions as Column expressions; no UDF, all inside codegen.

Whitespace is Unicode whitespace throughout (``WS``), as segments carry
no-break spaces.  IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
LATIN = r"[\p{L}&&[\u0000-ɏ]]"
NON_LATIN = r"[Ѐ-ӿ؀-ۿ　-鿿가-힯぀-ゟ゠-ヿ]"
EDGE_PUNCT = " .,!?;:'\"()-"

# Hesitation words taken out of segments.
DISFLUENCIES = ("uh", "um", "eh", "er", "ah", "hm", "hmm", "uhm", "erm")

# Words the recogniser splits, by language (pairs equal on both sides change nothing).
COMPOUNDS = {
    "en": {
        "off side": "offside", "on side": "onside", "goal keeper": "goalkeeper", "goal keeping": "goalkeeping", "full time": "fulltime",
        "kick off": "kick-off", "throw in": "throw-in", "break away": "breakaway", "counter attack": "counterattack", "over time": "overtime",
        "play maker": "playmaker", "mid field": "midfield", "mid fielder": "midfielder", "back heel": "backheel", "cross bar": "crossbar",
    },
    "sv": {
        "av sida": "avside", "halv tid": "halvtid", "mål vakt": "målvakt", "mitt fält": "mittfält", "fri spark": "frispark",
        "hörn spark": "hörnspark", "straff spark": "straffspark",
    },
}

# Language families, labels and tags by language.
FAMILIES = {"en": ("en", "sco", "cy"), "sv": ("sv", "no", "da"), "fr": ("fr",), "es": ("es", "ca", "gl", "pt"), "it": ("it",)}
ENTITY_LABELS = {"en": ("PERSON", "ORG", "GPE", "FAC"), "default": ("PER", "ORG", "LOC", "MISC")}
REJECTED_POS = {
    "en": ("ADJ", "VERB", "DET", "ADP", "ADV", "NOUN", "CCONJ", "SCONJ", "AUX", "INTJ", "PART", "PRON"),
    "default": ("DET", "ADP", "CCONJ", "SCONJ", "AUX", "PART", "PRON", "INTJ"),
}
# The recogniser's model by language.
ASR_MODELS = {"en": "Systran/faster-whisper-large-v3", "sv": "KBLab/kb-whisper-large", "no": "KBLab/kb-whisper-large", "da": "KBLab/kb-whisper-large", "default": "Systran/faster-whisper-large-v3"}
# Marks of a prompt that comes back.
ECHO_MARKERS = ("Match:", "Half:", "Teams:", "Players:", "Coaches:", "Referee:", "Venue:", "Prev:", "Next:", "Input:", "Output:", "Corrected:", "LINEUP", "<|", "|>")
# Fixed value: punctuation deleted before error rates are counted.
WER_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—–…“”‘’„‟"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once: inside lambdas nothing else is shared."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    """Non-empty whitespace-separated tokens."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def strip_chars(c: Column, chars: str) -> Column:
    """Takes any of ``chars`` off both ends."""
    cls = "[" + "".join("\\" + x for x in chars) + "]+"
    return F.regexp_replace(c, f"^{cls}|{cls}$", "")


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, "[" + "".join("\\" + x for x in chars) + "]+$", "")


def is_upper_first(c: Column) -> Column:
    """Whether the first character is an upper-case letter."""
    return c.rlike(r"^\p{Lu}")


def is_all_upper(c: Column) -> Column:
    """At least one cased letter, and none in lower case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def alpha_ratio(c: Column) -> Column:
    """[P1] Latin letters among visible characters; 0 where there are none."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]|[\u0250-\x{10ffff}]", ""))
    visible = F.length(F.regexp_replace(c, WS, ""))
    return F.when(visible > 0, letters / visible).otherwise(F.lit(0.0))


def non_latin(c: Column) -> Column:
    """[P2]"""
    return c.rlike(NON_LATIN)


def removal_reason(c: Column, detected: Column | None = None, expected: Column | None = None) -> Column:
    """[P3] Why a segment is dropped, null if it stays; first reason wins.

    ``detected`` is a detector's language, null where it can't tell; without
    one the language is not looked at [P4].
    """
    t = strip(F.coalesce(c, F.lit("")))
    ratio = alpha_ratio(t)
    out = (
        F.when(t == "", "empty_segment").when(non_latin(t), "non_latin_characters")
        .when(ratio < 0.5, F.concat(F.lit("low_alpha_ratio ("), F.format_string("%.2f", F.bround(ratio, 2)), F.lit(")")))
    )
    if detected is not None:
        out = out.when(wrong_language(t, detected, expected), "wrong_language_detected")
    return out


def wrong_language(c: Column, detected: Column, expected: Column, least_words: int = 15) -> Column:
    """[P4] A long enough text in a language outside the expected one's family."""
    family = F.lit(False)
    for head, members in FAMILIES.items():
        family = F.when(expected == head, detected.isin(*members)).otherwise(family)
    known = expected.isin(*FAMILIES)
    inside = F.when(known, family).otherwise(detected == expected)
    return (F.size(words(c)) >= least_words) & detected.isNotNull() & ~inside


def by_language(language: Column, table: dict) -> Column:
    """[P12] The entry of a language, else the default one."""
    pick = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    out = pick(table["default"])
    for code, value in table.items():
        if code != "default":
            out = F.when(language == code, pick(value)).otherwise(out)
    return out


def dedup_key(c: Column) -> Column:
    """[F2]"""
    return strip(rstrip_chars(strip(c), ".,!?;:"))


def drop_disfluencies(c: Column) -> Column:
    """[F3]"""
    return F.regexp_replace(c, r"(?iU)\b(?:" + "|".join(DISFLUENCIES) + r")\b", "")


def disfluencies(c: Column) -> Column:
    """Those found, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?iU)\b(" + "|".join(DISFLUENCIES) + r")\b"), 1)


def merge_compounds(c: Column, language: str) -> Column:
    """One replacement after the other, in the table's order."""
    for wrong, right in COMPOUNDS.get(language, {}).items():
        c = F.regexp_replace(c, rf"(?iU)\b{wrong}\b", right)
    return c


def squeeze_punct(c: Column) -> Column:
    """[F5]"""
    return F.regexp_replace(c, r"([.!?,;:])\1+", "$1")


def squeeze_space(c: Column) -> Column:
    """Two or more whitespace characters become a space; a single one stays."""
    return strip(F.regexp_replace(c, f"{WS}{{2,}}", " "))


def normalise(c: Column, language: Column) -> Column:
    """[F3-F6] The whole normalisation of a segment's text."""
    base = drop_disfluencies(c)
    merged = base
    for code in COMPOUNDS:
        merged = F.when(language == code, merge_compounds(base, code)).otherwise(merged)
    return squeeze_space(squeeze_punct(merged))


def _spans(c: Column, pattern: Column) -> Column:
    """Matches of a pattern's only group, and their first characters' places, as structs."""
    hits, gaps = F.regexp_extract_all(c, pattern, F.lit(1)), F.split(c, pattern, -1)
    chars = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    return F.transform(hits, lambda h, i: F.struct(h.alias("w"), (chars(gaps, i + 1) + chars(hits, i)).alias("at")))


def normalisation_audit(c: Column, language: Column) -> Column:
    """original, corrected, method, stage, position, confidence of each removed hesitation and merged compound, in order.

    Positions are of the text as each step finds it: the given one for
    hesitations, for a compound the one the earlier steps have made.
    """

    def row(span: Column, corrected: Column) -> Column:
        return F.struct(span["w"].alias("original"), corrected.alias("corrected"), F.lit("normalization").alias("method"), F.lit("2A").alias("stage"), span["at"].alias("position"), F.lit(1.0).alias("confidence"))

    pairs = F.array().cast("array<struct<wrong:string,right:string>>")
    for code, table in COMPOUNDS.items():
        pairs = F.when(language == code, F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right")) for w, r in table.items()])).otherwise(pairs)

    def step(acc: Column, pair: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iU)\b("), pair["wrong"], F.lit(r")\b"))
        merged = F.struct(
            F.regexp_replace(acc["text"], pattern, pair["right"]).alias("text"),
            F.concat(acc["rows"], F.transform(_spans(acc["text"], pattern), lambda x: row(x, pair["right"]))).alias("rows"),
        )
        return F.when(F.contains(F.lower(acc["text"]), pair["wrong"]), merged).otherwise(acc)

    pauses = _spans(c, F.lit(r"(?iU)\b(" + "|".join(DISFLUENCIES) + r")\b"))
    start = F.struct(drop_disfluencies(c).alias("text"), F.transform(pauses, lambda x: row(x, F.lit(""))).alias("rows"))
    return F.aggregate(pairs, start, step, lambda acc: acc["rows"])


def collapse_repeats(c: Column) -> Column:
    """[W3] Runs of three or more equal words become the first; texts of three words and more are joined by single spaces."""


    def of(w: Column, low: Column) -> Column:
        n = F.size(w)

        def keep(i):
            same = lambda k: F.coalesce(F.get(low, i) == F.get(low, i + k), F.lit(False))
            # the first of a run, or the second of exactly two
            return ~same(-1) | (~same(-2) & ~same(1))

        short = F.when(n < 3, c)
        return short.otherwise(F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n - 1), keep), lambda i: F.get(w, i)), " "))

    return let(words(c), lambda w: let(F.transform(w, F.lower), lambda low: of(w, low)))


def has_loop(c: Column) -> Column:
    """Three equal neighbours."""
    equal = lambda w: lambda i: (F.get(w, i) == F.get(w, i + 1)) & (F.get(w, i) == F.get(w, i + 2))
    at = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))
    return let(F.transform(words(c), F.lower), lambda w: (F.size(w) >= 3) & F.exists(at(w), equal(w)))


def has_verb_like(c: Column) -> Column:
    """[F33]"""
    w = F.transform(words(F.lower(c)), lambda x: strip_chars(x, ".,;:!?"))
    return F.exists(w, lambda x: (F.length(x) > 4) & x.rlike(r"(?:ing|ed|es|s)$"))


def garbage_class(c: Column, detected: Column | None = None) -> Column:
    """[P6] 'real', 'ambiguous' or 'garbage'; letters are counted among all characters."""
    n = F.size(words(c))
    ratio = F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)
    out = F.when((n < 3) | (ratio < 0.5) | has_loop(c), "garbage")
    if detected is not None:
        out = out.when((n >= 5) & detected.isNotNull() & (detected != "en"), "garbage")
    return out.when((n >= 5) & has_verb_like(c), "real").when(n >= 7, "real").otherwise("ambiguous")


# Fixed value: what a capitalised word looks like.
CAPITALISED = r"(?U)\b([A-ZÅÄÖÆØ][a-zà-ÿ]+(?:['-][A-Za-zÅÄÖÆØà-ÿ]+)*)\b"


def capitalised_words(c: Column) -> Column:
    """[P7]"""
    return F.regexp_extract_all(c, F.lit(CAPITALISED), 1)


def confidence_band(score: Column) -> Column:
    """[P10]"""
    return F.when(score >= 80, "high").when(score >= 70, "medium").otherwise("low")


def first_target(text: Column, targets: Column) -> Column:
    """[P9] The first target the text has, null if none."""
    return F.get(F.filter(targets, lambda t: F.contains(F.lower(text), F.lower(t))), F.lit(0))


def surname(c: Column) -> Column:
    """[F8] All but the first word; a single word stays."""
    w = words(c)
    return F.when(F.size(w) <= 1, strip(c)).otherwise(F.array_join(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), " "))


def name_variants(c: Column) -> Column:
    """Ordered pairs and initials of names of three words and more."""
    w = words(c)
    n = F.size(w)
    index = F.sequence(F.lit(0), n - 1)
    pairs = F.flatten(F.transform(index, lambda i: F.transform(F.filter(index, lambda j: j > i), lambda j: F.concat_ws(" ", F.get(w, i), F.get(w, j)))))
    last = F.element_at(w, -1)
    one = F.concat(F.substring(F.get(w, F.lit(0)), 1, 1), F.lit(". "), last)
    all_ = F.concat(F.array_join(F.transform(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: F.substring(x, 1, 1)), "."), F.lit(". "), last)
    return F.when(n >= 3, F.concat(pairs, F.array(one, all_))).otherwise(F.array().cast("array<string>"))


def venue_name(c: Column) -> Column:
    """[F10]"""
    return strip(F.regexp_replace(c, rf"{WS}*\([^\n]*?\){WS}*$", ""))


ENTITY_PARTS = r"(?s)^([.,!?;:]+(?=[^.,!?;:])|)(.*?)((?:['’]s)?)((?i: and co)?)([.,!?;:]*)$"


def entity_parts(c: Column) -> Column:
    """lead, core, possessive, tail, stop: what surrounds a name, taken off in a fixed order."""
    t = strip(c)
    part = lambda n: F.regexp_extract(t, ENTITY_PARTS, n)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("possessive"), part(4).alias("tail"), part(5).alias("stop"))


def entity_core(c: Column) -> Column:
    return entity_parts(c)["core"]


def rebuild_entity(original: Column, name: Column, language: Column) -> Column:
    """The new name in the old surroundings; a Nordic genitive s stays."""
    p = entity_parts(original)
    genitive = language.isin("sv", "no", "da") & (F.length(p["core"]) >= 4) & p["core"].endswith("s") & ~name.endswith("s") & (p["possessive"] == "")
    return F.concat(p["lead"], F.when(genitive, F.concat(name, F.lit("s"))).otherwise(name), p["possessive"], p["tail"], p["stop"])


def unaccented(c: Column) -> Column:
    """for Latin letters, as an expression: precomposed ones are mapped, combining marks dropped (any script: ``similarity.nfkd``)."""
    plain = F.translate(c, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžčćďěľňřťůńśźżąęőűāēīōūÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŠŽČĆ", "aaaaaaceeeeiiiinooooouuuuyyszccdelnrtunszzaeouaeiouAAAAAACEEEEIIIINOOOOOUUUUYSZCC")
    return F.regexp_replace(plain, r"\p{M}+", "")


def word_count_changed_or_drift(original: Column, corrected: Column, editable: Column) -> Column:
    """Whether a word outside ``editable`` (array<boolean>) changed, stops and case aside."""
    bare = lambda x: F.lower(strip_chars(x, " .,!?;:'\"-—–…"))


    def drift(o: Column, n: Column) -> Column:
        index = F.sequence(F.lit(0), F.greatest(F.size(o) - 1, F.lit(0)))
        moved = F.exists(index, lambda i: (F.get(o, i) != F.get(n, i)) & (bare(F.get(o, i)) != bare(F.get(n, i))) & ~F.coalesce(F.get(editable, i), F.lit(False)))
        return (F.size(o) != F.size(n)) | ((F.size(o) > 0) & moved)

    return let(words(original), lambda o: let(words(corrected), lambda n: drift(o, n)))


def length_anomaly(original: Column, output: Column) -> Column:
    """[F20]"""
    o, n = F.size(words(original)), F.size(words(output))
    return F.when(o == 0, n > 0).otherwise((n / o < 0.5) | (n / o > 1.5))


def prompt_echo(c: Column) -> Column:
    """[F21]"""
    out = F.lit(False)
    for marker in ECHO_MARKERS:
        out = out | F.contains(c, F.lit(marker))
    return out


def clean_output(c: Column) -> Column:
    """First line of a model's answer without prefix and quotes."""
    t = F.regexp_replace(strip(c), rf"^(?i:corrected|output|answer){WS}*[:\-]{WS}*", "")
    quoted = t.rlike(r"^[\"'][\s\S]*[\"']$") & (F.length(t) >= 1)
    t = strip(F.when(quoted, F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t))
    return strip(F.get(F.split(t, "\n", 2), F.lit(0)))


def unwrap(c: Column) -> Column:
    """<token> marks taken off."""
    return strip(F.regexp_replace(c, "<([^<>]+)>", "$1"))


def wer_normal(c: Column) -> Column:
    """Lower case, ASCII punctuation and a few dashes and quotes deleted, single spaces."""
    return F.array_join(words(F.translate(F.lower(c), WER_PUNCT, "")), " ")


def wer_normal_alternative(c: Column) -> Column:
    """Everything but word characters and ' becomes a space."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_']", " "), f"{WS}+", " "))


def rstrip_possessive(c: Column) -> Column:
    """Any trailing ' and s characters."""
    return F.regexp_replace(c, "['s]+$", "")


def hms_seconds(c: Column) -> Column:
    """h:m:s, m:s or s to seconds; null for anything else."""
    p = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    n = F.size(p)
    return F.when(n == 3, p[0] * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2))).when(n == 2, p[0] * 60 + F.get(p, F.lit(1))).when(n == 1, p[0])


def seek_offset(part: Column, start: Column, part2_offset: Column) -> Column:
    """[F29]"""
    return F.when(part == 2, start + F.coalesce(part2_offset, F.lit(0.0))).otherwise(start)


def clip_title(minute: Column, part: Column) -> Column:
    """[F30]"""
    return F.concat(F.lit("~"), minute.cast("string"), F.lit("' — "), F.when(part == 1, "1st half").otherwise("2nd half"))


def clock(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def match_key(league: Column, season: Column, name: Column) -> Column:
    """<league>_<season>_<match with '_' for spaces and slashes>"""
    return F.concat_ws("_", league, season, F.translate(name, " /", "__"))


def global_id(match: Column, half: Column, segment: Column) -> Column:
    """[F31]"""
    return F.concat(match, F.lit("__h"), half.cast("string"), F.lit("__s"), segment)


def letters_key(c: Column) -> Column:
    """[F32]"""
    return F.lower(strip(F.regexp_replace(c, r"[^\p{L} ]", "")))


def restore_punctuation(c: Column, labels: Column) -> Column:
    """Inserts a label (array<string>, '' for none) after each word that has no stop, and capitalises sentence starts.

    Nothing there is taken away.  ``labels`` has an entry per word.
    """
    stopped = lambda x: x.rlike(r"[.,?!:;\-]$")

    def step(w, acc, i):
        word = F.get(w, i)
        piece = F.when(acc["up"], F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.greatest(F.length(word), F.lit(1))))).otherwise(word)
        label = F.coalesce(F.get(labels, i), F.lit(""))
        add = (label != "") & ~stopped(piece)
        return F.struct(
            F.concat(acc["out"], F.when(i > 0, " ").otherwise(""), piece, F.when(add, label).otherwise("")).alias("out"),
            F.when(add, label.isin(".", "?")).otherwise(piece.rlike(r"[.?!]$")).alias("up"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("up"))
    folded = lambda w: F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), start, lambda acc, i: step(w, acc, i))["out"]
    return let(words(c), lambda w: F.when(F.size(w) == 0, strip(c)).otherwise(F.regexp_replace(folded(w), rf"{WS}+([.,?!:;])", "$1")))
