"""Name spans of a model beside the heuristic ones, surface variants, refused candidates, widened queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.functions.similarity import indel_ratio, metaphone
from touchline.operators.entity import gate, retrieve, uses_of
from touchline.operators.guards import heard_places

# Fixed value: stops taken off a token before it is looked up.
TOKEN_EDGES = ".,;:!?\"'()[]{}"


def labelled(spans: DataFrame, label: str, language: Column) -> DataFrame:
    """[M6] The spans whose label counts as a name in the language (of ENTITY_LABELS)."""
    kept = F.array_contains(T.by_language(language, T.ENTITY_LABELS), F.col(label))
    return spans.where(kept)


def without_overlaps(spans: DataFrame, over: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """[J11] The spans that overlap none of ``over`` in the same text (``keys``); nulls in keys or offsets overlap nothing."""
    other = over.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col(start).alias("__os"), F.col(end).alias("__oe"))
    on = [F.col(k) == F.col(f"__o_{k}") for k in keys] + [F.col(start) < F.col("__oe"), F.col(end) > F.col("__os")]
    return spans.join(other, on, "left_anti")


def combined_spans(model: DataFrame, heuristic: DataFrame, keys: Sequence[str], start: str, end: str, label: str, language: Column) -> DataFrame:
    """[M6, J11] The model's spans with a name's label, and the heuristic ones beside them.  Both have the same columns."""
    own = labelled(model, label, language)
    return own.unionByName(without_overlaps(heuristic, own, keys, start, end))


def real_words(df: DataFrame, text: str, dictionary: DataFrame | None, word: str = "word") -> DataFrame:
    """[P11] Adds real_word: whether the lower-cased text is in the dictionary; without one nothing is."""
    if dictionary is None:
        return df.withColumn("real_word", F.lit(False))
    known = dictionary.select(F.lower(word).alias("__w")).where("__w is not null").distinct().withColumn("__real", F.lit(True))
    return df.join(known, F.lower(F.col(text)) == F.col("__w"), "left").withColumn("real_word", F.coalesce("__real", F.lit(False))).drop("__w", "__real")


def tags_at(tokens: Column, offset: Column) -> Column:
    """[P13] The tag of the first token (array<struct<start,end,pos>>) that covers the offset, else ''."""
    at = F.filter(tokens, lambda t: (t["start"] <= offset) & (offset < t["end"]))
    return F.coalesce(F.get(F.transform(at, lambda t: t["pos"]), F.lit(0)), F.lit(""))


def tags_of_words(words: Column, tagged: Column, tags: Column) -> Column:
    """[P13] The tag of each word, the tagger having cut the text in its own way: words pair as in ``heard_places``; '' without a partner."""
    return F.transform(heard_places(words, tagged), lambda p: F.coalesce(F.get(tags, p - 1), F.lit("")))


def surface_variants(texts: DataFrame, canonicals: DataFrame, by: Sequence[str], text: str, floor: float = 70.0) -> DataFrame:
    """[A7] by, canonical, variant, uses: how often each writing near a canonical name stands in the texts.

    One-word names are looked for in words, two-word names in pairs of words,
    that begin with a capital; the letters-only lower-case forms may differ by
    4 or 5 in length and must reach the Indel ratio ``floor``.  Longer names
    have no variants.  canonicals: by[0], canonical.  Each distinct pair of
    forms is compared once.
    """
    # the words are found once a text, not once for each of its pairs
    ones = lambda w: F.transform(w, lambda x: F.struct(F.lit(1).alias("n"), x.alias("form")))
    # the last word begins no pair
    twos = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(F.lit(2).alias("n"), F.concat(x, F.lit(" "), F.get(w, i + 1)).alias("form")))
    listed = T.let(T.words(F.col(text)), lambda w: F.concat(ones(w), twos(w)))
    forms = texts.where(F.col(text).isNotNull()).select(*by, F.explode(listed).alias("x")).where(T.is_upper_first(F.col("x.form")))
    used = forms.groupBy(*by, F.col("x.n").alias("__n"), T.letters_key(F.col("x.form")).alias("variant")).agg(F.count("*").alias("uses")).where("variant <> ''")
    names = canonicals.select(by[0], "canonical", F.size(T.words(F.col("canonical"))).alias("__n"), T.letters_key(F.col("canonical")).alias("__k")).distinct().where("__n <= 2 and __k <> ''")
    lv, lk = F.length("variant"), F.length("__k")
    pair = used.join(names, [by[0], "__n"]).where((F.abs(lv - lk) <= F.col("__n") + 3) & (200 * F.least(lv, lk) >= floor * (lv + lk)))
    near = pair.select("variant", "__k").distinct().withColumn("__r", indel_ratio(F.col("variant"), F.col("__k"))).where(F.col("__r") >= floor)
    return pair.join(near, ["variant", "__k"]).select(*by, "canonical", "variant", "uses")


def variant_delta(raw: DataFrame, cleaned: DataFrame, by: Sequence[str]) -> DataFrame:
    """[A8] by, canonical: variants and uses of both sides, delta of the variants, mark (collapsed, expanded or '')."""
    sums = lambda df, p: df.groupBy(*by, "canonical").agg(F.countDistinct("variant").alias(f"{p}_variants"), F.sum("uses").alias(f"{p}_uses"))
    both = sums(raw, "raw").join(sums(cleaned, "cleaned"), [*by, "canonical"], "full_outer")
    out = both.select(*by, "canonical", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_variants", "raw_uses", "cleaned_variants", "cleaned_uses")]).withColumn("delta", F.col("cleaned_variants") - F.col("raw_variants"))
    return out.withColumn("mark", F.when(F.col("delta") < 0, "collapsed").when(F.col("delta") > 0, "expanded").otherwise(""))


def top_drops(delta: DataFrame, by: Sequence[str], top: int = 15) -> DataFrame:
    """[T8] The ``top`` rows of ``variant_delta`` that lost most variants."""
    return delta.orderBy("delta", *by, "canonical").limit(top)


def refused_candidates(names: DataFrame, tokens: DataFrame, canonicals: DataFrame, accepted: DataFrame | None = None, dictionary: DataFrame | None = None, frequent: int = 5) -> DataFrame:
    """[M11] match_id, token, best, cosine, fuzz, freq, bucket: why each found name was not corrected.

    names: match_id, text (found names).  tokens: match_id, text (all texts,
    for the frequency).  canonicals: match_id, canonical.  accepted: match_id,
    original, corrected.  Names are counted once a match, case aside; canonical
    names and accepted pairs are left out.  The gates are replayed in order on
    the nearest canonical by cosine: frequency, cosine under 0.40, short with a
    ratio under 85, ratio under 65, then what the conservative gates refuse
    (ratio under 60, length, dictionary).  Ratios keep case and compare with
    the whole canonical.  Names all gates let pass give no row.
    """
    bare = T.strip_chars(F.col("text"), TOKEN_EDGES)
    found = names.where(F.col("text").isNotNull()).select("match_id", bare.alias("token")).where("token <> ''").groupBy("match_id", F.lower("token").alias("key")).agg(F.min("token").alias("token"))
    known = canonicals.select("match_id", F.lower("canonical").alias("key")).distinct()
    # not to be broadcast: exploded from a small file it passes for small
    fresh = found.join(known.hint("merge"), ["match_id", "key"], "left_anti")
    best = retrieve(fresh.select("match_id", F.col("token").alias("query")), canonicals, top=1, rescue=101.0).select("match_id", F.col("query").alias("token"), F.col("canonical").alias("best"), F.col("score").alias("cosine"))
    rows = best.withColumn("key", F.lower("token"))
    if accepted is not None:
        done = accepted.select("match_id", F.lower("original").alias("key"), F.lower("corrected").alias("__b")).distinct()
        rows = rows.join(done, (rows["match_id"] == done["match_id"]) & (rows["key"] == done["key"]) & (F.lower("best") == done["__b"]), "left_anti")
    freq = uses_of(found.select("match_id", "key"), tokens, TOKEN_EDGES)
    rows = real_words(rows.join(freq, ["match_id", "key"], "left").withColumn("freq", F.coalesce("freq", F.lit(0))), "token", dictionary)
    rows = rows.withColumn("fuzz", indel_ratio(F.col("token"), F.col("best")))
    lt, lb = F.length("token"), F.length("best")
    bucket = (
        F.when(F.col("freq") >= frequent, "frequency_heuristic").when(F.col("cosine") < 0.40, "shortcut_reject_low_cosine")
        .when((lt < 5) & (F.col("fuzz") < 85), "mcq_pregate_short_low_fuzz").when(F.col("fuzz") < 65, "mcq_pregate_low_fuzz")
        .when(gate(F.col("token"), F.col("best"), F.col("fuzz"), F.col("real_word")), F.lit(None).cast("string"))
        .when(F.col("fuzz") < 60, "validation_c1_fuzzy_floor").when(F.abs(lt - lb) > F.greatest(F.lit(2.0), 0.6 * lt), "validation_c2_length_tolerance").otherwise("validation_dict_veto")
    )
    return rows.withColumn("bucket", bucket).where("bucket is not null").select("match_id", "token", "best", "cosine", "fuzz", "freq", "bucket")


def expanded_queries(queries: DataFrame, names: DataFrame, by_sound: bool = False) -> DataFrame:
    """[M16] qid, query, wider: the query with the writings of the names its words mean.

    names: canonical, variant (as ``surface_variants`` finds them).  A query
    word means a canonical if it is one of its words or variants, case aside,
    or (``by_sound``) has the metaphone code of one.  New words follow the
    query in order; queries that mean nobody stay as they are.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(T.words(F.lower("query")))).alias("w"))
    forms = names.select("canonical", F.explode(F.array_distinct(F.concat(T.words(F.lower("canonical")), T.words(F.lower("variant"))))).alias("w")).distinct()
    met = asked.join(forms, "w").select("qid", "canonical")
    if by_sound:
        sound = forms.select("canonical", metaphone(F.col("w")).alias("s")).where("s <> ''").distinct()
        met = met.unionByName(asked.select("qid", metaphone(F.col("w")).alias("s")).where("s <> ''").join(sound, "s").select("qid", "canonical"))
    more = met.distinct().join(forms, "canonical").select("qid", "w").distinct().join(asked, ["qid", "w"], "left_anti").groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("__more"))
    return queries.join(more, "qid", "left").select("qid", "query", F.concat_ws(" ", "query", "__more").alias("wider"))


Relevant = Callable[[pd.DataFrame], pd.Series]


def relevant_hits(hits: DataFrame, judge: Relevant | None = None, refused: DataFrame | None = None) -> DataFrame:
    """[M17] The hits (qid, query, text, ...) an injected judge keeps, none of refused queries (qid).

    ``judge`` gets (query, text) and gives booleans; without one all are kept.
    """
    if refused is not None:
        hits = hits.join(refused.select("qid").distinct(), "qid", "left_anti")
    if judge is None:
        return hits
    return hits.where(F.pandas_udf(lambda q, t: judge(pd.DataFrame({"query": q, "text": t})).astype(bool), "boolean")("query", "text"))


def changed_rows(raw: DataFrame, cleaned: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """[J12] keys, before, after: rows of both whose text changed; null keys are equal, a text that became null changed."""
    row = F.struct(*[F.col(k).alias(k) for k in keys]).alias("__row")
    both = raw.select(row, F.col(text).alias("before")).join(cleaned.select(row, F.col(text).alias("after")), "__row")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*[F.col(f"__row.{k}").alias(k) for k in keys], "before", "after")


def with_registry(hits: DataFrame, registry: DataFrame, key: str, title: str, extra: Sequence[str] = ()) -> DataFrame:
    """[J14] Adds ``title`` of the registry, else the key itself, and ``extra``, else ''."""
    known = registry.select(F.col(key).alias("__key"), F.col(title).alias("__title"), *[F.col(c).cast("string").alias(f"__x_{c}") for c in extra]).dropDuplicates(["__key"])
    out = hits.join(known, F.col(key) == F.col("__key"), "left")
    return out.withColumns({title: F.coalesce("__title", F.col(key)), **{c: F.coalesce(f"__x_{c}", F.lit("")) for c in extra}}).drop("__key", "__title", *[f"__x_{c}" for c in extra])


def telemetry(decisions: DataFrame, code: str, example: str, order: Sequence[str], most: int = 5) -> DataFrame:
    """[A24] code, n, examples (the first ``most``, in order), line: how often each branch was taken."""
    w = Window.partitionBy(code).orderBy(*order)
    first = decisions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).groupBy(code).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", F.col(example).cast("string").alias("__e")))), lambda x: x["__e"]).alias("examples"))
    n = decisions.groupBy(code).agg(F.count("*").alias("n"))
    out = n.join(first, code)
    return out.select(code, "n", "examples", F.concat(F.col(code), F.lit("="), F.col("n").cast("string"), F.lit(" ["), F.array_join("examples", ", "), F.lit("]")).alias("line"))
