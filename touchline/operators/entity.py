"""Names in segments: heuristic spans, candidates, gates, decisions."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.functions.similarity import indel_ratio, indel_ratio_of
from touchline.operators import folds
from touchline.operators.ordered import KEY, with_neighbours, with_rank
from touchline.operators.ordered import entity as entity_key
from touchline.session import cut_lineage

_SPACE = re.compile(f"{T.WS}+")

# Fixed value: hashes of words that may be broadcast.
HASHES = 1 << 18


def word_spans(c: Column) -> Column:
    """array<struct<i,word,start>>: whitespace-separated words with their offsets in the text."""
    pieces = F.regexp_extract_all(c, F.lit(f"({T.WS}*[^{T.WS[1:]}+)"), 1)

    def of(p: Column, lengths: Column) -> Column:
        start = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) - F.length(T.strip(F.get(p, i)))
        return F.transform(p, lambda x, i: F.struct(i.alias("i"), T.strip(x).alias("word"), start(i).alias("start")))

    return T.let(pieces, lambda p: T.let(F.transform(p, F.length), lambda lengths: of(p, lengths)))


def capital_spans(df: DataFrame, ids: Sequence[str], text: str, pos: str | None = None, language: Column | None = None) -> DataFrame:
    """[M3] Capitalised words of three letters and more that aren't function words.

    ``pos``, if given, is array<string> of tags by word.  A tag of the
    language's rejected set drops a word; at the start of a text only PROPN
    is taken, so without tags the first word never is.
    Returns ids, text, start_char, end_char, source, pos.
    """
    w = df.select(*ids, (language if language is not None else F.lit("en")).alias("__lang"), (F.col(pos) if pos else F.array().cast("array<string>")).alias("__pos"), F.explode(word_spans(F.col(text))).alias("x"))
    bare = T.strip_chars(F.col("x.word"), ".,!?;:'\"")
    tag = F.coalesce(F.get("__pos", F.col("x.i")), F.lit(""))
    found = w.select(*ids, bare.alias("text"), (F.col("x.start") + F.length(F.regexp_extract(F.col("x.word"), r"^([.,!?;:'\"]*)", 1))).alias("start_char"), tag.alias("pos"), "__lang", F.col("x.i").alias("__i"))
    ok = (F.length("text") >= 3) & F.col("text").rlike(r"^\p{Lu}") & ~F.array_contains(T.by_language(F.col("__lang"), T.REJECTED_POS), F.col("pos")) & ((F.col("__i") > 0) | (F.col("pos") == "PROPN"))
    return found.where(ok).select(*ids, "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"), F.lit("heuristic_capitalized_non_function").alias("source"), "pos")


def short_segment_names(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """[M2] Capitalised words of three letters and more in texts of at most three words: ids, text."""
    return df.where(F.size(T.words(F.col(text))) <= 3).select(*ids, F.explode(T.capitalised_words(F.col(text))).alias("text")).where(F.length("text") >= 3)


def gazetteer_words(gazetteer: DataFrame, least: int = 5) -> DataFrame:
    """match_id, word: lower-cased words of variants and canonicals."""
    w = F.concat(T.words(F.col("canonical")), T.words(F.col("variant")))
    return gazetteer.select("match_id", F.explode(w).alias("w")).where(F.length("w") >= least).select("match_id", F.lower("w").alias("word")).distinct()


def nearest_words(tokens: DataFrame, words: DataFrame, floor: float = 75.0, spread: int = 4) -> DataFrame:
    """[J3, J10] match_id, token, score: best Indel ratio of each token to its match's words, at ``floor`` or more.

    Tokens that are words themselves are left out first.  Only pairs whose
    lengths allow the floor reach the ratio, and each distinct pair once.
    """
    fresh = tokens.select("match_id", "token").distinct().join(words.withColumnRenamed("word", "token"), ["match_id", "token"], "left_anti")
    lt, lw = F.length("token"), F.length("word")
    pair = fresh.join(words, "match_id").where((F.abs(lt - lw) <= spread) & (200 * F.least(lt, lw) >= floor * (lt + lw)))
    scored = pair.select("token", "word").distinct().withColumn("score", indel_ratio(F.col("token"), F.col("word"))).where(F.col("score") >= floor)
    return pair.join(scored, ["token", "word"]).groupBy("match_id", "token").agg(F.max("score").alias("score"))


def misheard_spans(df: DataFrame, ids: Sequence[str], text: str, words: DataFrame, dictionary: DataFrame | None = None, floor: float = 75.0, real_word_floor: float = 90.0, least: int = 5) -> DataFrame:
    """[M4] Words of any case close to a gazetteer word: ids, text, start_char, end_char, score.

    ``dictionary`` (word), if given, holds real words, which need ``real_word_floor`` [P11].
    """
    w = df.select("match_id", *ids, F.explode(word_spans(F.col(text))).alias("x"))
    bare = T.strip_chars(F.col("x.word"), ".,!?;:'\"()-—–…")
    lead = F.length(F.regexp_extract(F.col("x.word"), r"^([.,!?;:'\"()\-—–…]*)", 1))
    found = w.select("match_id", *ids, bare.alias("text"), (F.col("x.start") + lead).alias("start_char")).where((F.length("text") >= least) & F.col("text").rlike(r"^[\p{L}'\-]+$") & F.col("text").rlike(r"\p{L}")).withColumn("token", F.lower("text"))
    near = nearest_words(found, words, floor)
    if dictionary is not None:
        real = dictionary.select(F.lower("word").alias("token")).distinct().withColumn("__real", F.lit(True))
        near = near.join(real, "token", "left").where(F.col("__real").isNull() | (F.col("score") >= real_word_floor)).drop("__real")
    return found.join(near, ["match_id", "token"]).select("match_id", *ids, "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"), "score")


def uses_of(names: DataFrame, texts: DataFrame, edges: str) -> DataFrame:
    """[A1] match_id, key, freq: how often each name is a word of its match's texts, case and ``edges`` aside.

    names: match_id, key (lower-cased, not empty).  texts: match_id, text.
    Most words are no names: only those whose hash some name has leave their
    task.  The hashes broadcast are at most HASHES, however many names there
    are; words that share one with a name are counted and match no name.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(HASHES)).cast("int")
    asked = names.where(~F.col("key").contains(" ")).select(place.alias("__h")).distinct()
    # words have no line ends, so trimming is what ``strip_chars`` does
    w = texts.select("match_id", F.explode(F.split("text", f"{T.WS}+")).alias("w")).select("match_id", F.lower(F.btrim("w", F.lit(edges))).alias("key"))
    return w.withColumn("__h", place).join(F.broadcast(asked), "__h", "left_semi").groupBy("match_id", "key").agg(F.count("*").alias("freq"))


def _grams(low: str, least: int = 2, most: int = 4) -> list[str]:
    """Character n-grams inside words padded with a space on both sides; a padded word no longer than n gives itself once and stops."""
    out = []
    for w in _SPACE.split(low):
        if w:
            p = f" {w} "
            for n in range(least, most + 1):
                if len(p) > n:
                    out += [p[i : i + n] for i in range(len(p) - n + 1)]
                elif n == least or len(p) == n:
                    out.append(p)
    return out


def _index(names: list[dict], n: int) -> dict[str, tuple[float, list[tuple[int, float]]]]:
    """gram: its idf, and the names that have it with their weights, each divided by its name's norm."""
    counts = [Counter(_grams(x["low"])) for x in names]
    df = Counter(g for c in counts for g in c)
    idf = {g: math.log((1 + n) / (1 + k)) + 1 for g, k in df.items()}
    out: dict[str, tuple[float, list[tuple[int, float]]]] = {g: (x, []) for g, x in idf.items()}
    for i, c in enumerate(counts):
        size = math.sqrt(math.fsum((tf * idf[g]) ** 2 for g, tf in c.items()))
        for g, tf in c.items():
            out[g][1].append((i, tf * idf[g] / size))
    return out


def _cosines(low: str, index: dict[str, tuple[float, list[tuple[int, float]]]]) -> dict[int, float]:
    """The cosine with each name that shares a gram."""
    dot: dict[int, float] = {}
    size = 0.0
    for g, tf in Counter(_grams(low)).items():
        if g in index:
            idf, having = index[g]
            size += (tf * idf) ** 2
            for i, w in having:
                dot[i] = dot.get(i, 0.0) + tf * idf * w
    size = math.sqrt(size)
    return {i: x / size for i, x in dot.items()}


def _retrieved(top: int, rescue: float, shortcut: float):
    """The ``top`` names for each of a row's queries, both being lists of the row."""
    fits = lambda x, y: 200 * min(x, y) >= rescue * (x + y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], float] = {}
        rows: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32()))], names=["match_id", "query", "canonical", "score", "n"])
        for batch in batches:
            for match, queries, names, n in zip(*(batch.column(k) for k in range(4))):
                match, queries, names = match.as_py(), queries.as_py(), names.as_py()
                index = _index(names, n.as_py())
                words: dict[str, list[int]] = {}
                for i, x in enumerate(names):
                    for w in x["words"] if rescue <= 100 else ():
                        words.setdefault(w, []).append(i)
                for q in queries:
                    score = _cosines(q["low"], index)
                    best: dict[int, float] = {}
                    for w, having in words.items():
                        if fits(len(q["text"]), len(w)):
                            if (q["low"], w) not in seen:
                                if len(seen) >= 200_000:
                                    seen.clear()
                                seen[q["low"], w] = indel_ratio_of(q["low"], w)
                            if (r := seen[q["low"], w]) >= rescue:
                                for i in having:
                                    best[i] = max(best.get(i, 0.0), r)
                    for i, r in best.items():
                        score[i] = max(score.get(i, 0.0), min(r / 100, shortcut - 1e-6))
                    # names come in order, so equal scores do
                    order = heapq.nsmallest(top, ((-round(x, 9), i) for i, x in score.items() if x > 0))
                    rows += [(match, q["text"], names[i]["text"], score[i], k) for k, (_, i) in enumerate(order, 1)]
                    if len(rows) >= 10_000:
                        yield pack()
                        rows.clear()
        if rows:
            yield pack()

    return run


def retrieve(queries: DataFrame, canonicals: DataFrame, top: int = 5, rescue: float = 65.0, shortcut: float = 0.90, together: int = 1000) -> DataFrame:
    """[J4, F17, F18, T3] match_id, query, canonical, score, n: the ``top`` canonicals of the match for each query.

    Smooth-idf weighted cosine through an inverted index of n-grams, within
    the match.  A canonical with a word of Indel ratio ``rescue`` or more
    counts at least that ratio, kept just under ``shortcut``.  Ties go to the
    canonical first in order.  Null keys and names match nothing.

    A match's list of names travels to its queries, which are in parts of
    about ``together``: no match is one task.  Neither side is ever broadcast,
    as Spark takes what is exploded from a small file for small.
    """
    c = canonicals.select("match_id", "canonical").where("match_id is not null")
    name = F.struct(F.col("canonical").alias("text"), F.lower("canonical").alias("low"), F.transform(T.words(F.col("canonical")), F.lower).alias("words"))
    names = c.groupBy("match_id").agg(F.sort_array(F.collect_set(F.when(F.col("canonical").isNotNull(), name))).alias("names"), F.max(F.col("canonical").isNull().cast("int")).alias("__null"))
    q = queries.select("match_id", "query").where("match_id is not null and query is not null")
    # at most one row for ``together`` queries
    large = q.groupBy("match_id").agg(F.ceil(F.count("*") / together).alias("__k")).where("__k > 1")
    parts = q.join(F.broadcast(large), "match_id", "left").withColumn("__part", F.pmod(F.xxhash64("query"), F.coalesce("__k", F.lit(1))))
    asked = parts.groupBy("match_id", "__part").agg(F.collect_set(F.struct(F.col("query").alias("text"), F.lower("query").alias("low"))).alias("queries"))
    spread = names.join(F.broadcast(large), "match_id", "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__k", F.lit(1)) - 1)))
    both = asked.join(spread.hint("merge"), ["match_id", "__part"]).select("match_id", "queries", "names", (F.size("names") + F.col("__null")).alias("n"))
    return both.mapInArrow(_retrieved(top, rescue, shortcut), "match_id string, query string, canonical string, score double, n int")


def reduced(entity: Column, canonical: Column, best: Column) -> Column:
    """[F16] For a one-word entity and a longer canonical the word found nearest, else the canonical."""
    return F.when(F.contains(entity, F.lit(" ")) | ~F.contains(canonical, F.lit(" ")), canonical).otherwise(best)


def _nearest_words(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for entities, words, lows in batches:
        seen: dict[tuple, str | None] = {}
        out = []
        for e, ws, ls in zip(entities, words, lows):
            at = None if e is None or ws is None else (e, *ws)
            if at is not None and at not in seen:
                seen[at] = ws[max(range(len(ws)), key=lambda i: (indel_ratio_of(e, ls[i]), -i))] if len(ws) else None
            out.append(seen.get(at))
        yield pd.Series(out, dtype="object")


def reduce_to_word(df: DataFrame, entity: str, canonical: str, out: str) -> DataFrame:
    """[F16] Adds ``out``; of equally near words the first."""
    many = ~F.contains(F.col(entity), F.lit(" ")) & F.contains(F.col(canonical), F.lit(" "))
    words = F.when(many, T.words(F.col(canonical)))
    nearest = F.pandas_udf(_nearest_words, "string")(F.lower(entity), words, F.transform(words, F.lower))
    return df.withColumn(out, F.coalesce(nearest, F.col(canonical)))


def gate(original: Column, corrected: Column, ratio: Column, real_word: Column | None = None) -> Column:
    """Whether a correction passes: equal but for case; else ratio 60, no dictionary word under 75, length within max(2, 0.6 n)."""
    lo, lc = F.length(original), F.length(corrected)
    room = F.greatest(F.lit(2), F.floor(lo * 0.6 + 1e-9).cast("int"))
    veto = (ratio < 75) & (F.length(T.strip_chars(original, T.EDGE_PUNCT)) >= 4) & real_word if real_word is not None else F.lit(False)
    return (lo > 0) & (lc > 0) & ((F.lower(T.strip(original)) == F.lower(T.strip(corrected))) | ((ratio >= 60) & ~veto & (F.abs(lc - lo) <= room)))


def contexts(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """[W5] match_id, half, segment_id, previous, text, next of the asked segments (match_id, half, segment_id), in the match's order of half and ord.

    Segments are ranked without their texts; then the texts of the asked ones
    and their neighbours travel, no others.
    """
    key = ["match_id", "half", "segment_id"]
    order = (F.col("half").cast("long") * (1 << 44) + F.col("ord")).alias("__t")
    ranked = with_rank(segments.select(entity_key(["match_id"]), "half", "segment_id", order), "__t", ["segment_id"]).select(F.col(f"{KEY}.match_id").alias("match_id"), "half", "segment_id", "__rank")
    marked = ranked.join(asked.select(*key).distinct().withColumn("__asked", F.lit(True)), key, "left").select(entity_key(["match_id"]), "half", "segment_id", "__rank", "__asked")
    near = with_neighbours(marked, F.col("__asked"), {"__before": -1, "__after": 1}).where("__asked or __before or __after")
    near = cut_lineage(near.select(F.col(f"{KEY}.match_id").alias("match_id"), "half", "segment_id", "__rank", "__asked"))
    # beside an asked segment nothing is missing, so ranks are neighbours there
    told = near.join(segments.select(*key, "text"), key).select(entity_key(["match_id"]), "half", "segment_id", "text", "__rank", "__asked")
    return cut_lineage(with_neighbours(told, F.col("text"), {"previous": -1, "next": 1}).where("__asked").select(F.col(f"{KEY}.match_id").alias("match_id"), "half", "segment_id", "previous", "text", "next"))


Judge = Callable[[pd.DataFrame], pd.Series]


def correct_entities(
    segments: DataFrame, spans: DataFrame, gazetteer: DataFrame, cache: DataFrame | None = None, judge: Judge | None = None,
    veto: Judge | None = None, dictionary: DataFrame | None = None, language: str = "en", frequent: int = 5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[M7, J2, A1, A2, W5, W9, W11] The entity cascade of a match, as a plan over distinct names.

    segments: match_id, half, segment_id, ord, text.  spans: match_id, half,
    segment_id, text, start_char, end_char.  gazetteer: match_id, variant,
    canonical.  cache: mishearing, correct, matches_seen (a snapshot).
    ``judge`` gets rows (entity, candidates, previous, text, next) and gives
    letters A to E or None; without one uncertain names stay.  ``veto`` gets
    (entity, picked, text) and gives booleans.

    A decision depends on the lower-cased name and the context of its first
    occurrence only, so each distinct name of a match is decided once and the
    decision joined back.  Corrections name the method by occurrence: the
    first is tfidf_shortcut or mcq_judge, later ones validated_cache (ratio 75
    and more) or per_match_cache.

    Returns decisions (match_id, key, code, applied, method, score, choice),
    corrections (one row per changed span) and segments with new text and
    frozen word positions.
    """
    key = ["match_id", "half", "segment_id"]
    place = F.struct("half", "ord", -F.col("start_char"))
    sp = spans.withColumn("entity", T.entity_core(F.col("text"))).where(F.length(T.strip(F.col("entity"))) > 2).withColumn("key", F.lower("entity"))
    placed = sp.join(segments.select(*key, "ord"), key)
    first = placed.groupBy("match_id", "key").agg(F.min_by(F.struct("entity", "half", "segment_id"), place).alias("f"), F.min(place).alias("earliest")).select("match_id", "key", "f.*", "earliest")

    # row by row: a join with the distinct pairs would have the whole plan twice, and so each step after it
    ratios = lambda df, a, b, out: df.withColumn(out, indel_ratio(F.lower(a), F.lower(b)))

    real = None
    if dictionary is not None:
        first = first.join(dictionary.select(F.lower("word").alias("__d")).distinct(), F.lower(T.strip_chars(F.col("entity"), T.EDGE_PUNCT)) == F.col("__d"), "left").withColumn("real", F.col("__d").isNotNull()).drop("__d")
        real = F.col("real")
    # 1. validated cache
    known = cache.where(F.size("matches_seen") >= 1).select(F.lower("mishearing").alias("key"), F.col("correct").alias("cached")) if cache is not None else None
    d = first.join(known, "key", "left") if known is not None else first.withColumn("cached", F.lit(None).cast("string"))
    d = ratios(d, "entity", "cached", "cached_ratio") if known is not None else d.withColumn("cached_ratio", F.lit(None).cast("double"))
    d = d.withColumn("from_cache", F.coalesce((F.lower("cached") != F.col("key")) & gate(F.col("entity"), F.col("cached"), F.col("cached_ratio"), real), F.lit(False)))
    d = cut_lineage(d)
    # 2. how often the name is a word of the match, if often enough to count; this, the gazetteer and the lists are plans of their own, as
    # the driver holds a plan again each time one of its stages ends
    uses = cut_lineage(uses_of(d.select("match_id", "key"), segments, T.EDGE_PUNCT).where(F.col("freq") >= frequent))
    # 3. retrieval
    canonicals = cut_lineage(gazetteer.select("match_id", "canonical"))
    hits = retrieve(d.where("not from_cache").select("match_id", F.col("entity").alias("query")), canonicals, top=3)
    listed = cut_lineage(hits.groupBy("match_id", "query").agg(F.sort_array(F.collect_list(F.struct("n", "canonical", "score"))).alias("c")))
    d = d.join(uses, ["match_id", "key"], "left").join(listed.withColumnRenamed("query", "entity"), ["match_id", "entity"], "left")
    best, second = F.try_element_at("c", F.lit(1)), F.try_element_at("c", F.lit(2))
    d = d.withColumns({"best": best["canonical"], "score": best["score"], "gap": best["score"] - F.coalesce(second["score"], F.lit(0.0))})
    d = ratios(reduce_to_word(d, "entity", "best", "word"), "entity", "word", "word_ratio")
    shortcut = (F.col("score") >= 0.90) & (F.col("gap") >= 0.10)
    code = (
        F.when(F.col("from_cache"), "cache_hit_validated").when(F.col("best").isNull(), "auto_reject_low").when(F.lower("best") == F.col("key"), "self_match")
        .when(F.coalesce("freq", F.lit(0)) >= frequent, "auto_reject_freq_heuristic").when(F.col("score") < 0.40, "auto_reject_low")
        .when(shortcut & gate(F.col("entity"), F.col("word"), F.col("word_ratio"), real), "auto_accept_shortcut").when(shortcut, "auto_reject_dict_veto")
        .when((F.length(T.strip(F.col("entity"))) < 5) & (F.col("word_ratio") < 85), "auto_reject_low").when(F.col("word_ratio") < 65, "auto_reject_low")
        .otherwise("uncertain")
    )
    candidates = F.when(F.col("code") == "uncertain", F.transform("c", lambda x: x["canonical"])).alias("candidates")
    d = cut_lineage(d.withColumn("code", code).select("match_id", "key", "entity", "half", "segment_id", "earliest", "code", "cached", "word", "word_ratio", "score", candidates, *(["real"] if dictionary is not None else [])))
    # 4. the judge sees the uncertain ones only
    unsure = d.where("code = 'uncertain'")
    context = contexts(segments, unsure)
    asked = unsure.join(context, key, "left").select("match_id", "key", "entity", "candidates", F.coalesce("previous", F.lit("")).alias("previous"), "text", F.coalesce("next", F.lit("")).alias("next"), *(["real"] if dictionary is not None else []))
    if judge is not None:
        asked = asked.withColumn("choice", F.pandas_udf(lambda e, c, p, t, n: judge(pd.DataFrame({"entity": e, "candidates": c, "previous": p, "text": t, "next": n})), "string")("entity", "candidates", "previous", "text", "next"))
    else:
        asked = asked.withColumn("choice", F.lit(None).cast("string"))
    at = F.when(F.col("choice") == "A", 0).when(F.col("choice") == "B", 1).when(F.col("choice") == "C", 2)
    asked = asked.withColumn("picked_name", F.get("candidates", at))
    asked = ratios(reduce_to_word(asked, "entity", "picked_name", "picked"), "entity", "picked", "picked_ratio")
    passed = asked.withColumn("fits", F.coalesce(gate(F.col("entity"), F.col("picked"), F.col("picked_ratio"), real), F.lit(False)))
    if veto is not None:
        refuse = F.pandas_udf(lambda e, p, t: veto(pd.DataFrame({"entity": e, "picked": p, "text": t})).astype(bool), "boolean")("entity", "picked", "text")
        passed = cut_lineage(passed)
        passed = passed.join(passed.where("fits").select("match_id", "key", refuse.alias("vetoed")), ["match_id", "key"], "left")
    else:
        passed = passed.withColumn("vetoed", F.lit(False))
    asked = passed.select(
        "match_id", "key", "choice", "picked", "picked_ratio",
        F.when(F.col("choice").isNull(), "mcq_call_failed").when(F.col("choice") == "D", "mcq_chose_keep").when(F.col("picked_name").isNull(), "mcq_chose_unsure")
        .when(~F.col("fits"), "auto_reject_dict_veto").when(F.col("vetoed"), "mlm_vetoed_mcq").otherwise("mcq_chose_candidate").alias("judged"),
    )
    d = d.join(asked, ["match_id", "key"], "left").withColumn("code", F.coalesce("judged", "code"))
    applied = F.when(F.col("code") == "cache_hit_validated", F.col("cached")).when(F.col("code") == "auto_accept_shortcut", F.col("word")).when(F.col("code") == "mcq_chose_candidate", F.col("picked"))
    method = F.when(F.col("code") == "cache_hit_validated", "validated_cache").when(F.col("code") == "auto_accept_shortcut", "tfidf_shortcut").when(F.col("code") == "mcq_chose_candidate", "mcq_judge")
    ratio = F.when(F.col("code") == "auto_accept_shortcut", F.col("word_ratio")).otherwise(F.col("picked_ratio"))
    decided = cut_lineage(d.select("match_id", "key", "code", applied.alias("applied"), method.alias("method"), F.when(F.col("code") == "cache_hit_validated", 100.0).otherwise(F.col("score") * 100).alias("score"), "choice", ratio.alias("ratio"), "earliest"))
    # back to the spans, from the right of each segment
    hit = placed.join(decided.where("applied is not null"), ["match_id", "key"])
    again = (place != F.col("earliest")) & (F.col("method") != "validated_cache")
    corrections = hit.select(
        *key, F.col("entity").alias("original"), F.col("applied").alias("corrected"),
        F.when(again, 100.0).otherwise(F.bround("score", 1)).alias("score"),
        F.when(again & (F.col("ratio") >= 75), "validated_cache").when(again, "per_match_cache").otherwise(F.col("method")).alias("method"),
        F.when(~again, F.col("choice")).alias("judge_choice"), (F.col("entity") != F.col("applied")).alias("changed"), "start_char", "end_char",
        T.rebuild_entity(F.col("text"), F.col("applied"), F.lit(language)).alias("new"),
    )
    edits = corrections.groupBy(*key).agg(
        F.collect_list(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"), "new")).alias("edits"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("start_char")).alias("o"), "corrected"))), lambda x: x["corrected"]).alias("names"),
    )
    out = segments.join(edits, key, "left").withColumn("text", F.when(F.col("edits").isNotNull(), folds.splice(F.col("text"), F.col("edits"))).otherwise(F.col("text")))
    frozen = F.when(F.col("names").isNotNull(), folds.frozen_positions(T.words(F.col("text")), F.col("names")))
    out = out.withColumn("frozen_word_indices", F.when(F.size(frozen) > 0, frozen)).drop("edits", "names")
    return decided.drop("earliest"), corrections.drop("new", "start_char", "end_char"), out


def record_cache(cache: DataFrame | None, accepted: DataFrame, least_ratio: float = 75.0) -> DataFrame:
    """[M13, A19, K2] The cache with a run's accepted corrections (match_id, key, corrected, ratio, ord) taken in.

    The first mapping of a mishearing holds; others are refused, a match
    counts once, ratios under ``least_ratio`` not at all.  Returns mishearing,
    correct, matches_seen, fuzzy_avg.
    """
    new = accepted.where(F.col("ratio") >= least_ratio)
    first = new.groupBy("key").agg(F.min_by("corrected", F.struct("ord", "match_id")).alias("first"))
    if cache is not None:
        old = cache.select(F.col("mishearing").alias("key"), "correct", "matches_seen", "fuzzy_avg")
        first = first.join(old.select("key", "correct"), "key", "left").select("key", F.coalesce("correct", "first").alias("first"))
    fits = new.join(first, "key").where(F.col("corrected") == F.col("first")).groupBy("key", "match_id").agg(F.min_by("ratio", "ord").alias("ratio"), F.first("first").alias("correct"))
    if cache is not None:
        seen = old.select("key", F.explode("matches_seen").alias("match_id"))
        fits = fits.join(seen, ["key", "match_id"], "left_anti")
    added = fits.groupBy("key").agg(F.first("correct").alias("correct"), F.sort_array(F.collect_set("match_id")).alias("m"), F.sum("ratio").alias("s"))
    if cache is None:
        return added.select(F.col("key").alias("mishearing"), "correct", F.col("m").alias("matches_seen"), (F.col("s") / F.size("m")).alias("fuzzy_avg"))
    joined = old.withColumnRenamed("correct", "__c").join(added, "key", "full_outer")
    n_old, n_new = F.coalesce(F.size("matches_seen"), F.lit(0)), F.coalesce(F.size("m"), F.lit(0))
    n_old, n_new = F.greatest(n_old, F.lit(0)), F.greatest(n_new, F.lit(0))
    empty = F.array().cast("array<string>")
    avg = (F.coalesce("fuzzy_avg", F.lit(0.0)) * n_old + F.coalesce("s", F.lit(0.0))) / F.greatest(n_old + n_new, F.lit(1))
    return joined.select(F.col("key").alias("mishearing"), F.coalesce("__c", "correct").alias("correct"), F.concat(F.coalesce("matches_seen", empty), F.coalesce("m", empty)).alias("matches_seen"), avg.alias("fuzzy_avg"))


def seed_proposals(tokens: DataFrame, canonicals: DataFrame, cache: DataFrame | None = None, dictionary: DataFrame | None = None, floor: float = 80.0, show: int | None = None) -> DataFrame:
    """[M12, T4, J10] match_id, token, canonical, score, n, weight: frequent capitalised tokens near a canonical.

    tokens: match_id, token, n.  Canonicals themselves, dictionary words and
    what the cache has are left out.  Of equally near canonicals the first in order.
    """
    t = tokens.withColumn("__l", F.lower("token")).join(canonicals.select("match_id", F.lower("canonical").alias("__l")).distinct(), ["match_id", "__l"], "left_anti")
    for other, c in ((dictionary, "word"), (cache, "mishearing")):
        if other is not None:
            t = t.join(other.select(F.lower(c).alias("__l")).distinct(), "__l", "left_anti")
    lt, lc = F.length("token"), F.length("canonical")
    pair = t.drop("__l").join(canonicals.select("match_id", "canonical").distinct(), "match_id").where(200 * F.least(lt, lc) >= floor * (lt + lc))
    r = pair.select("token", "canonical").distinct().withColumn("score", indel_ratio(F.col("token"), F.col("canonical"))).where(F.col("score") >= floor)
    w = Window.partitionBy("match_id", "token").orderBy(F.desc("score"), "canonical")
    best = pair.join(r, ["token", "canonical"]).withColumn("k", F.row_number().over(w)).where("k = 1").select("match_id", "token", "canonical", "score", "n", (F.col("score") * F.col("n")).alias("weight"))
    return best.orderBy(F.desc("weight"), "match_id", "token").limit(show) if show else best
