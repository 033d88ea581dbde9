"""Error rates and entity scores of aligned texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.functions.similarity import edit_distance, word_edits


def pair_edits(df: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """[A10] Adds substitutions, insertions, deletions, hits of each pair's words (texts already normalised)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([word_edits((x or "").split(), (y or "").split()) for x, y in zip(a, b)], columns=["substitutions", "insertions", "deletions", "hits"])

    udf = F.pandas_udf(run, "substitutions long, insertions long, deletions long, hits long")
    return df.withColumn("__e", udf(ref, hyp)).select("*", "__e.*").drop("__e")


def pairwise_wer(pairs: DataFrame, by: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """[A10] Micro-averaged word error rate by group; pairs with an empty reference are left out."""
    norm = pairs.select(*by, T.wer_normal_alternative(F.col(ref)).alias("__r"), T.wer_normal_alternative(F.col(hyp)).alias("__h")).where("__r <> ''")
    e = pair_edits(norm, F.col("__r"), F.col("__h"))
    sums = e.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("substitutions", "insertions", "deletions", "hits")])
    words = F.col("substitutions") + F.col("deletions") + F.col("hits")
    return sums.select(*by, words.alias("ref_words"), "substitutions", "insertions", "deletions", "hits", ((F.col("substitutions") + F.col("insertions") + F.col("deletions")) / words).alias("wer"))


def corpus_texts(pairs: DataFrame, by: Sequence[str], order: Sequence[str], ref: Column, hyp: Column) -> DataFrame:
    """[A21] Both sides' texts of a group, each joined by single spaces in order."""
    listed = pairs.select(*by, F.struct(*order, ref.alias("__r"), hyp.alias("__h")).alias("__x")).groupBy(*by).agg(F.sort_array(F.collect_list("__x")).alias("__x"))
    side = lambda c: F.trim(F.regexp_replace(F.array_join(F.transform("__x", lambda x: x[c]), " "), " +", " "))
    return listed.select(*by, side("__r").alias("ref_text"), side("__h").alias("hyp_text"))


def corpus_error(pairs: DataFrame, by: Sequence[str], order: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """[A9] Word and character error rate of each group's joined texts (a half of a match, never more).

    The alignment is quadratic in a group's words, its rows being numpy
    vectors; characters go through a bit-parallel distance.  An empty
    reference gives zeros.
    """
    texts = corpus_texts(pairs, by, order, T.wer_normal(F.col(ref)), T.wer_normal(F.col(hyp)))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = []
            for x, y in zip(a, b):
                s, i, d, h = word_edits(x.split(), y.split()) if x else (0, 0, 0, 0)
                rows.append((len(x.split()), len(y.split()) if x else 0, s, i, d, h, (s + i + d) / len(x.split()) if x else 0.0, edit_distance(x, y) / len(x) if x else 0.0))
            yield pd.DataFrame(rows, columns=["ref_words", "hyp_words", "substitutions", "insertions", "deletions", "hits", "wer", "cer"])

    udf = F.pandas_udf(run, "ref_words long, hyp_words long, substitutions long, insertions long, deletions long, hits long, wer double, cer double")
    return texts.withColumn("__e", udf("ref_text", "hyp_text")).select(*by, "__e.*")


EDGES = T.WER_PUNCT


def without_names(c: Column) -> Column:
    """[A11] The text's words that are no proper nouns, normalised."""
    bare = F.filter(F.transform(T.words(c), lambda w: T.strip_chars(w, EDGES)), lambda w: (w != "") & ~(w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}")))
    return F.array_join(F.filter(F.transform(bare, lambda w: F.translate(F.lower(w), EDGES, "")), lambda w: w != ""), " ")


def entity_tokens(c: Column) -> Column:
    """[A12] Distinct lower-cased words of three letters and more that begin with a capital and aren't all capitals."""
    w = F.transform(T.words(c), lambda x: T.strip_chars(x, EDGES))
    return F.array_distinct(F.transform(F.filter(w, lambda x: (F.length(x) >= 3) & x.rlike(r"^\p{Lu}") & ~T.is_all_upper(x)), F.lower))


def entity_f1(pairs: DataFrame, by: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """[A12] Precision, recall and F1 of the sets of entity tokens of each group."""
    side = lambda c, n: pairs.select(*by, F.explode(entity_tokens(F.col(c))).alias("t"), F.lit(n).alias("s"))
    has = side(ref, 1).unionByName(side(hyp, 2)).groupBy(*by, "t").agg(F.max((F.col("s") == 1).cast("int")).alias("r"), F.max((F.col("s") == 2).cast("int")).alias("h"))
    n = has.groupBy(*by).agg(F.sum("r").alias("r"), F.sum("h").alias("h"), F.sum(F.col("r") * F.col("h")).alias("b"))
    every = pairs.select(*by).distinct().join(n, list(by), "left").fillna(0, ["r", "h", "b"])
    return every.select(*by, *f1_of(F.col("b"), F.col("h") - F.col("b"), F.col("r") - F.col("b")))


def f1_of(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1; nothing on either side is 1, 1, 1; no hypothesis 0, 0, 0; no reference 0, 1, 0."""
    none, no_hyp, no_ref = (tp + fp + fn) == 0, (tp + fp) == 0, (tp + fn) == 0
    p = F.when(none, 1.0).when(no_hyp, 0.0).otherwise(tp / (tp + fp))
    r = F.when(none, 1.0).when(no_hyp, 0.0).when(no_ref, 1.0).otherwise(tp / (tp + fn))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def listed_f1(pairs: DataFrame, by: Sequence[str], ref: str, hyp: str, listed: DataFrame, word: str) -> DataFrame:
    """[A13] Micro-averaged F1 over pairs, of the distinct words of a pair that are in ``listed``.

    Words lose surrounding stops and trailing ' and s.
    """
    clean = lambda c: F.transform(T.words(F.col(c)), lambda w: F.lower(F.regexp_replace(T.rstrip_possessive(T.strip_chars(w, ".,;:!?\"'()[]{}")), "'+$", "")))
    rows = pairs.withColumn("__p", F.monotonically_increasing_id())
    tokens = rows.select(*by, "__p", F.explode(F.array_distinct(clean(ref))).alias("t"), F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(rows.select(*by, "__p", F.explode(F.array_distinct(clean(hyp))).alias("t"), F.lit(0).alias("r"), F.lit(1).alias("h")))
    kept = tokens.join(listed.select(F.lower(word).alias("t")).distinct(), "t", "left_semi")
    n = kept.groupBy(*by, "__p", "t").agg(F.max("r").alias("r"), F.max("h").alias("h")).groupBy(*by).agg(F.sum(F.col("r") * F.col("h")).alias("tp"), F.sum((1 - F.col("r")) * F.col("h")).alias("fp"), F.sum(F.col("r") * (1 - F.col("h"))).alias("fn"))
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return n.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def metrics(pairs: DataFrame, by: Sequence[str], order: Sequence[str], ref: str, hyp: str, n_hyp: str = "n_hyp") -> DataFrame:
    """[A27] One row a group: rates in percent (2 places, half to even), F1 (4 places), aligned and reference-only counts."""
    pct = lambda c: F.bround(F.col(c) * 100, 2).alias(c)
    counts = pairs.groupBy(*by).agg(F.count_if(F.col(n_hyp) > 0).alias("aligned"), F.count_if(F.col(n_hyp) == 0).alias("ref_only"))
    whole = corpus_error(pairs, by, order, ref, hyp)
    plain = corpus_error(pairs.withColumns({ref: without_names(F.col(ref)), hyp: without_names(F.col(hyp))}), by, order, ref, hyp).select(*by, F.col("wer").alias("non_entity_wer"))
    f1 = entity_f1(pairs, by, ref, hyp)
    out = whole.join(plain, list(by)).join(f1, list(by)).join(counts, list(by))
    return out.select(*by, pct("wer"), pct("cer"), pct("non_entity_wer"), "ref_words", "hyp_words", "substitutions", "insertions", "deletions", "hits", *[F.bround(c, 4).alias(f"entity_{c}") for c in ("precision", "recall", "f1")], "aligned", "ref_only")


def improvement(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """[A28] The best later row against the first: absolute deltas and the relative fall of the word error rate."""
    base = F.min_by(F.struct("wer", "f1"), order)
    listed = rows.groupBy(*by).agg(base.alias("__b"), F.min(order).alias("__o"))
    rest = rows.join(listed, list(by)).where(F.col(order) > F.col("__o")).groupBy(*by).agg(F.min(F.struct("wer", F.col(order).alias("o"), "f1")).alias("m"), F.first("__b").alias("b"))
    delta = F.col("b.wer") - F.col("m.wer")
    return rest.select(*by, F.col("b.wer").alias("baseline"), F.col("m.wer").alias("best"), delta.alias("delta"), F.when(F.col("b.wer") == 0, 0.0).otherwise(delta / F.col("b.wer") * 100).alias("relative"), (F.col("m.f1") - F.col("b.f1")).alias("f1_delta"))
