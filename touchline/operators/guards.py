"""Model-backed edits and the guards around them; every model is injected and may be absent."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators.ordered import KEY, with_neighbours, with_rank


# Fixed value: what a capitalised word looks like, with the stop behind it.
CAPITAL = r"^[A-ZÅÄÖÆØ][a-zà-ÿ]+(?:['-][A-Za-zÅÄÖÆØà-ÿ]+)*[.,!?;:]?$"


def _begins(c: Column, head: Column) -> Column:
    return F.substring(c, F.lit(1), F.length(head)) == head


def heard_places(tokens: Column, heard: Column) -> Column:
    """[W10] For each token the number (from 1) of the recogniser's word it is paired with, 0 if none.

    heard: the recogniser's words without surrounding stops.  A token's partner
    is the first word behind all partners so far such that one of the two
    begins with the other; a token that finds none uses up the rest.
    """

    def step(acc: Column, token: Column) -> Column:
        rest = F.slice(heard, acc["next"], F.greatest(F.size(heard) - acc["next"] + 1, F.lit(0)))
        fits = F.transform(rest, lambda w: F.coalesce((w != "") & (_begins(token, w) | _begins(w, token)), F.lit(False)))
        return T.let(
            F.array_position(fits, True).cast("int"),
            lambda at: T.let(
                F.when(at > 0, acc["next"] + at - 1).otherwise(F.lit(0)),
                lambda place: F.struct(F.when(at > 0, place + 1).otherwise(F.size(heard) + 1).alias("next"), F.concat(acc["places"], F.array(place)).alias("places")),
            ),
        )

    return F.aggregate(tokens, F.expr("named_struct('next', 1, 'places', cast(array() as array<int>))"), step, lambda acc: acc["places"])


def unsure(tokens: Column, heard: Column, gate: float = -0.3) -> Column:
    """Whether each token's log probability is below ``gate``; no partner, no probability or 0 counts as -10."""
    bare = F.transform(heard, lambda w: T.strip_chars(F.coalesce(w["word"], F.lit("")), " .,!?;:"))

    def below(place: Column) -> Column:
        p = F.when(place > 0, F.get(heard, place - 1)["prob"])
        return F.coalesce(F.when(p > 0, F.log(p)), F.lit(-10.0)) < gate

    return T.let(bare, lambda b: F.transform(heard_places(tokens, b), below))


def capitals(tokens: Column, variants: Column, first_tag: Column | None = None, rejected: Sequence[str] = ()) -> Column:
    """Whether each token is a capitalised word.

    The first one isn't if its tag is among ``rejected``, unless it is one of
    ``variants`` (array of lower-case names).
    """
    out = F.transform(tokens, lambda w: w.rlike(CAPITAL))
    if first_tag is None or not rejected:
        return out
    known = F.array_contains(variants, F.lower(T.strip_chars(F.get(tokens, F.lit(0)), " .,!?;:'\"-—–…")))
    opener = F.coalesce(first_tag.isin(*rejected), F.lit(False)) & ~F.coalesce(known, F.lit(False))
    return F.transform(out, lambda x, i: x & ~((i == 0) & opener))


def with_wrapped(df: DataFrame, text: str, words: str, frozen: str, variants: Column | None = None, first_tag: Column | None = None, rejected: Sequence[str] = (), gate: float = -0.3) -> DataFrame:
    """Adds wrapped (words that may be edited in <>), n_wrapped, editable (of each word).

    Words are chosen by probability where ``words`` (array of word, prob) is
    known, else by capitals; those at ``frozen`` positions never are.
    """
    tokens = T.words(F.coalesce(F.col(text), F.lit("")))
    chosen = F.when(F.size(words) > 0, unsure(F.col("__tokens"), F.col(words), gate)).otherwise(
        capitals(F.col("__tokens"), variants if variants is not None else F.expr("cast(array() as array<string>)"), first_tag, rejected)
    )
    held = F.coalesce(F.col(frozen), F.expr("cast(array() as array<int>)"))
    out = df.withColumn("__tokens", tokens).withColumn("editable", F.transform(chosen, lambda x, i: x & ~F.array_contains(held, i.cast("int"))))
    marked = F.zip_with("__tokens", "editable", lambda w, x: F.when(x, F.concat(F.lit("<"), w, F.lit(">"))).otherwise(w))
    return out.withColumn("wrapped", F.array_join(marked, " ")).withColumn("n_wrapped", F.size(F.filter("editable", lambda x: x))).drop("__tokens")


Propose = Callable[[pd.DataFrame], pd.Series]


def guarded_edits(df: DataFrame, ids: Sequence[str], match: str, order: Sequence[str], text: str, words: str, frozen: str, propose: Propose | None = None, review: Propose | None = None, least_wrapped: int = 2) -> DataFrame:
    """[M9, M18, F19-F22, J13, A24] A model's edits of uncertain words, taken only if every guard agrees.

    ``propose`` gets (wrapped, previous2, previous1, next1) and gives texts or
    None; ``review`` gets (original, proposal) and gives the text to keep.
    Without a model all rows pass unchanged.  Returns ids, original, new text,
    n_wrapped and outcome, the telemetry's counter.
    """
    base = with_wrapped(df, text, words, frozen).withColumn("__original", F.col(text))
    # order[0] is a long column, the rest break its ties
    ranked = with_rank(base.withColumn(KEY, F.struct(F.col(match))), order[0], list(order[1:]))
    base = with_neighbours(ranked, F.col(text), {"__p2": -2, "__p1": -1, "__n1": 1}).drop(KEY, "__rank")
    eligible = base.where(F.col("n_wrapped") >= least_wrapped)
    if propose is None:
        asked = eligible.withColumn("__raw", F.lit(None).cast("string"))
    else:
        asked = eligible.withColumn("__raw", F.pandas_udf(lambda t, a, b, c: propose(pd.DataFrame({"wrapped": t, "previous2": a, "previous1": b, "next1": c})), "string")("wrapped", "__p2", "__p1", "__n1"))
    p = asked.withColumn("__p", T.unwrap(T.clean_output(F.col("__raw"))))
    failed = F.col("__raw").isNull() | (F.col("__raw") == "")
    o, q = F.col("__original"), F.col("__p")
    outcome = (
        F.when(failed, "llm_call_failed").when((q == "") | (q == o), "no_op").when(T.prompt_echo(q), "rejected_prompt_echo")
        .when(T.length_anomaly(o, q), "rejected_length_anomaly").when(T.word_count_changed_or_drift(o, q, F.col("editable")), "rejected_editable_drift").otherwise("accepted")
    )
    judged = p.withColumn("outcome", outcome)
    if review is not None:
        kept = judged.where("outcome = 'accepted'").select(*ids, F.pandas_udf(lambda a, b: review(pd.DataFrame({"original": a, "proposal": b})), "string")("__original", "__p").alias("__final"))
        judged = judged.join(kept, list(ids), "left")
    else:
        judged = judged.withColumn("__final", q)
    final = judged.select(*ids, F.when((F.col("outcome") == "accepted") & (F.col("__final") == o), "no_op").otherwise(F.col("outcome")).alias("outcome"), "__final")
    out = base.select(*ids, F.col("__original").alias("original"), "n_wrapped").join(final, list(ids), "left")
    return out.select(*ids, "original", F.when(F.col("outcome") == "accepted", F.col("__final")).otherwise(F.col("original")).alias("text"), "n_wrapped", F.coalesce("outcome", F.lit("skipped_below_min")).alias("outcome"))


def restored(df: DataFrame, ids: Sequence[str], text: str, label: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """[M10, F24] Punctuation restored by an injected labeller (text to a label per word): ids, original, text, changed.

    Without one every text passes as it is.
    """
    if label is None:
        return df.select(*ids, F.col(text).alias("original"), F.col(text), F.lit(False).alias("changed"))
    labels = F.pandas_udf(lambda s: label(s), "array<string>")(text)
    out = df.withColumn("__l", labels).withColumn("__t", F.when(F.col(text).isNotNull(), T.restore_punctuation(F.col(text), F.col("__l"))))
    return out.select(*ids, F.col(text).alias("original"), F.col("__t").alias("text"), F.coalesce(F.col("__t") != F.col(text), F.lit(False)).alias("changed"))


def word_counts(df: DataFrame, text: str, language: str) -> DataFrame:
    """language, word, n: how often each word stands in the texts of a language; rows without a language don't count."""
    w = df.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("language"), F.explode(_plain_words(F.col(text))).alias("word"))
    return w.groupBy("language", "word").agg(F.count("*").alias("n"))


def _plain_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), " "), lambda w: w != "")


def detected_languages(texts: DataFrame, ids: Sequence[str], text: str, counts: DataFrame) -> DataFrame:
    """ids, detected: the language under whose ``word_counts`` the text's words are likeliest; no row if it has no counted word.

    Word probabilities are (n + 1) / (words of the language + different words
    of all); words counted nowhere say nothing.  Ties go to the first by name.
    Everything is joins and sums, so the counts may be of any size; only the
    languages themselves, one row each, are sent to every task.
    """
    row = F.struct(*[F.col(c).alias(c) for c in ids]).alias("__row")
    known = counts.select("word").distinct()
    w = texts.where(F.col(text).isNotNull()).select(row, F.explode(_plain_words(F.col(text))).alias("word")).groupBy("__row", "word").agg(F.count("*").alias("k"))
    w = w.join(known, "word")
    sizes = counts.groupBy("language").agg(F.sum("n").alias("N")).join(known.agg(F.count("*").alias("V"))).select("language", F.log(F.col("N") + F.col("V")).alias("size"))
    gain = w.join(counts, "word").groupBy("__row", "language").agg(F.sum(F.col("k") * F.log(F.col("n") + 1)).alias("gain"))
    said = w.groupBy("__row").agg(F.sum("k").alias("k")).join(F.broadcast(sizes))
    scored = said.join(gain, ["__row", "language"], "left").select("__row", F.struct((F.coalesce("gain", F.lit(0.0)) - F.col("k") * F.col("size")).alias("s"), "language").alias("x"))
    best = scored.groupBy("__row").agg(F.min(F.struct((-F.round("x.s", 9)).alias("neg"), "x.language")).alias("b"))
    return best.select("__row.*", F.col("b.language").alias("detected"))


def longest_texts(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sample: int = 20, least_words: int = 5) -> DataFrame:
    """[T2, M1] keys, text: of the ``sample`` longest texts of a match those of ``least_words`` and more, joined, longest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__n"), *order)
    top = df.withColumn("__n", F.size(T.words(F.col(text)))).withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= sample) & (F.col("__n") >= least_words))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", text))), lambda x: x[text]), " ").alias(text))


def match_language(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, detect: Callable[[DataFrame], DataFrame] | None = None, sample: int = 20, least_words: int = 5) -> DataFrame:
    """[M1] keys, language: the family head of what ``detect`` finds in a match's longest texts, 'en' if nothing.

    ``detect`` gets (keys, text) and gives (keys, detected); without one every
    match is 'en'.
    """
    every = df.select(*keys).distinct()
    if detect is None:
        return every.withColumn("language", F.lit("en"))
    head = F.col("detected")
    for code, members in reversed(list(T.FAMILIES.items())):
        head = F.when(F.col("detected").isin(*members), F.lit(code)).otherwise(head)
    got = detect(longest_texts(df, keys, order, text, sample, least_words)).select(*keys, head.alias("__h"))
    return every.join(got, list(keys), "left").select(*keys, F.coalesce("__h", F.lit("en")).alias("language"))


def majority(votes: DataFrame, by: Sequence[str], vote: str, order: str) -> DataFrame:
    """[A20] by, choice: the first most frequent vote if more than half have it, else 'D'; null if there is none."""
    n = votes.where(F.col(vote).isNotNull()).groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    top = n.groupBy(*by).agg(F.max_by(F.struct(vote, "n"), F.struct("n", -F.col("o"))).alias("t"), F.sum("n").alias("all"))
    got = top.select(*by, F.when(2 * F.col("t.n") > F.col("all"), F.col(f"t.{vote}")).otherwise("D").alias("choice"))
    return votes.select(*by).distinct().join(got, list(by), "left")
