"""Free-entered values to the entry of a reference list they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.utterance import folded
from touchline.session import cut_lineage


def value_key(c: Column) -> Column:
    """Letters and digits of the folded value, without possessive and 'and co'."""
    c = F.regexp_replace(folded(c), r"['’`´]s(?![\p{L}\p{N}])", "")
    c = F.regexp_replace(c, r"(?U)\band co\b\.?", " ")
    c = F.regexp_replace(c, r"^\s*#?\p{Nd}{1,2}[.)]?\s+(?=\S*\p{L})|(?<=[\p{L}\p{N}.])\s*[(\[][^()\[\]]*[)\]]\s*$", " ")
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]+", "")


def writings(canonical: Column, kind: Column, head_kinds: Sequence[str] = ("team", "venue")) -> Column:
    """The keys an entry may be written as: whole, and by its telling word.

    That word is the first for ``head_kinds`` (clubs and venues without their
    second word) and the last otherwise (surnames, also with an initial).
    """
    words = F.split(F.trim(canonical), r"\s+")
    whole = value_key(canonical)
    head = value_key(F.element_at(words, 1))
    tail = value_key(F.element_at(words, -1))
    swapped = F.concat(tail, head)
    initial = F.concat(F.substring(whole, 1, 1), tail)
    return F.array_distinct(F.when(kind.isin(*head_kinds), F.array(whole, head)).otherwise(F.array(whole, tail, initial, swapped)))


def grams(key: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the key between end marks."""
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def edits_within(key: Column, writing: Column) -> Column:
    """Edits between the two; null above a third of the writing's letters or above 3 and one more for each twelve letters."""
    gap = F.levenshtein(key, writing)
    most = F.least(F.floor(F.length(writing) / 3), 3 + F.floor(F.length(writing) / 12))
    # the lengths alone tell most of those that are too far apart
    return F.when((F.abs(F.length(key) - F.length(writing)) <= most) & (gap <= most), gap)


def map_to_list(
    values: DataFrame, reference: DataFrame, by: Sequence[str], value: str, ref_id: str = "ref_id", canonical: str = "canonical", kind: str = "entity_type",
    threshold: float = 0.25, margin: float = 0.15, lead: float = 0.02, head: float = 0.25, early: float = 0.5, salts: int = 8, most_broadcast: int = 500_000,
) -> DataFrame:
    """Maps each value to the reference row it means; returns by, ref_id, score.

    Values are reduced to keys and deduplicated before anything else.  An
    inverted index from character bigrams to the writings of the reference
    rows yields candidates, scored by the cosine of their bigrams under the
    weights ``ln((1 + N) / (1 + df)) + 1`` (unseen ones weigh like df = 0).  A
    row is a candidate if its cosine is at least ``threshold``, and is accepted
    if it leads every other by more than ``margin``.  Rows within the margin of
    the best are told apart by edit distance: the one that needs fewest edits,
    of as many the one that leads by ``lead`` in cosine.  An exact check
    follows: the accepted row must have a writing within ``edits_within``.

    The search is exact and has no cap.  The rarest bigrams of a key, ``head``
    of its weight, lead to a first writing; its cosine less the margin, or the
    threshold if that is more, is the key's floor.  The key then asks the index
    for its rarest bigrams only, as many as needed so that the rest has less of
    the key's norm than ``early`` of the floor; a writing that shares too little
    of them can't reach it.  The rest is looked up only for the pairs that can.

    Defined results: null and blank values give no row; a value without letters
    and digits, one accepted nowhere, and any value if the list is empty, gives
    ref_id -1 and score null or the best cosine; rows with equal ``by`` count
    once, with the smallest value; reference rows with a null id or name are
    left out; rows that can't be told apart are not accepted.  Values and names
    of any length take part whole.  The index is sent to every task up to
    ``most_broadcast`` postings and joined by shuffles above.
    """
    spark = values.sparkSession
    rows = (
        values.select(*[F.col(b) for b in by], F.col(value).alias("__v"))
        .where(r"__v rlike '(?U)\\S'")
        .groupBy(*by).agg(F.min("__v").alias("__v"))
    )
    distinct = rows.select("__v").distinct().withColumn("__key", value_key(F.col("__v")))
    entries = (
        reference.select(F.col(ref_id).alias("__ref"), F.col(canonical).alias("__c"), F.col(kind).alias("__kind"))
        .where("__ref is not null and __c is not null")
        .select("__ref", F.explode(writings(F.col("__c"), F.coalesce("__kind", F.lit("")))).alias("__w"))
        .where("__w <> ''").distinct()
    )
    # numbers stand for keys and writings in the search; they are written down before use
    listed = cut_lineage(entries.select("__w").distinct().withColumn("__wid", F.monotonically_increasing_id()))
    postings = listed.select("__wid", F.explode(grams(F.col("__w"))).alias("__g"))
    n = listed.agg(F.count("*").alias("__n"))
    weights = postings.groupBy("__g").agg(F.count("*").alias("__df")).join(F.broadcast(n)).select("__g", (F.log((F.col("__n") + 1) / (F.col("__df") + 1)) + 1).alias("__idf"))
    weighted = postings.join(weights, "__g")
    norms = weighted.groupBy("__wid").agg(F.sqrt(F.sum(F.col("__idf") * F.col("__idf"))).alias("__norm"))
    index = cut_lineage(weighted.join(norms, "__wid").select("__g", "__wid", "__idf", (F.col("__idf") / F.col("__norm")).alias("__y")))
    small = index.limit(most_broadcast + 1).count() <= most_broadcast
    near_by = F.broadcast if small else (lambda df: df)
    weights = index.groupBy("__g").agg(F.first("__idf").alias("__idf"))
    top = n.select((F.log(F.col("__n") + 1) + 1).alias("__max"))

    distinct = cut_lineage(distinct)
    keys = cut_lineage(distinct.select("__key").where(F.col("__key") != "").distinct().withColumn("__kid", F.monotonically_increasing_id()))
    each = Window.partitionBy("__kid")
    # the weight a bigram and the more common ones of its key have, of 1
    rest = F.sum(F.col("__x") * F.col("__x")).over(each.orderBy(F.desc("__x"), "__g").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = cut_lineage(
        keys.repartition(parts, "__kid").select("__kid", F.explode(grams(F.col("__key"))).alias("__g"))
        .join(near_by(weights), "__g", "left").join(F.broadcast(top))
        .withColumn("__x", F.coalesce("__idf", "__max"))
        .withColumn("__rest", rest).withColumn("__all", F.max("__rest").over(each))
        .select("__kid", "__g", (F.col("__x") / F.sqrt("__all")).alias("__x"), (F.col("__rest") / F.col("__all")).alias("__rest"), F.col("__idf").isNotNull().alias("__known"))
    )
    listing = near_by(index.select("__g", "__wid", "__y"))
    met = F.sum(F.col("__x") * F.col("__y"))
    # a first good writing by the rarest bigrams tells how far others may fall behind
    guess = asked.where(F.col("__known") & (F.col("__rest") > 1 - head)).repartition(parts, "__kid").join(listing, "__g").groupBy("__kid", "__wid").agg(met.alias("__dot"))
    guess = guess.groupBy("__kid").agg(F.max_by("__wid", "__dot").alias("__wid"))
    floor = asked.join(guess, "__kid").join(listing, ["__g", "__wid"]).groupBy("__kid").agg((met - margin - 1e-9).alias("__floor"))
    bounded = cut_lineage(
        asked.repartition(parts, "__kid").join(floor, "__kid", "left").withColumn("__floor", F.greatest(F.coalesce("__floor", F.lit(0.0)), F.lit(threshold)))
        .withColumn("__first", F.col("__rest") >= F.pow(F.col("__floor") * early, 2))
        .withColumn("__need", F.col("__floor") - F.sqrt(F.coalesce(F.max(F.when(~F.col("__first"), F.col("__rest"))).over(each), F.lit(0.0))))
        .where("__known").select("__kid", "__g", "__x", "__first", "__need")
    )
    begun = (
        bounded.where("__first").select("__kid", "__g", "__x", "__need").repartition(parts, "__kid").join(listing, "__g")
        .groupBy("__kid", "__wid").agg(met.alias("__dot"), F.max("__need").alias("__need"))
        .where("__dot >= __need")
    )
    late = bounded.where("not __first").select("__kid", "__g", "__x")
    scored = (
        begun.select("__kid", "__wid", "__dot").join(late, "__kid", "left").join(listing, ["__g", "__wid"], "left")
        .groupBy("__kid", "__wid").agg((F.max("__dot") + F.coalesce(met, F.lit(0.0))).alias("__cos"))
    )
    names = entries.groupBy("__ref").agg(F.collect_set("__w").alias("__ws"))
    candidates = (
        scored.join(near_by(listed.join(entries, "__w").select("__wid", "__ref")), "__wid").groupBy("__kid", "__ref").agg(F.max("__cos").alias("__cos"))
        .withColumn("__best", F.max("__cos").over(each))
        .where((F.col("__cos") >= F.col("__best") - margin) & (F.col("__best") >= threshold))
        .join(near_by(names), "__ref").join(keys, "__kid")
        .withColumn("__gap", F.array_min(F.transform("__ws", lambda w: edits_within(F.col("__key"), w))))
        .withColumn("__gap", F.when(F.col("__cos") >= threshold, F.col("__gap")))
    )
    order = F.struct(F.col("__gap").isNull().alias("far"), F.col("__gap").alias("gap"), (-F.col("__cos")).alias("neg"), F.col("__ref").alias("ref"))
    judged = candidates.withColumn("__one", F.min(order).over(each))
    rival = (F.col("__ref") != F.col("__one.ref")) & (F.col("__gap") == F.col("__one.gap")) & (-F.col("__cos") - F.col("__one.neg") < lead)
    told = judged.groupBy("__kid").agg(F.first("__one").alias("__one"), F.first("__best").alias("__best"), F.max(F.coalesce(rival, F.lit(False))).alias("__rival"))
    accepted = ~F.col("__one.far") & ~F.col("__rival")
    mapping = told.join(keys, "__kid").select("__key", F.when(accepted, F.col("__one.ref")).otherwise(F.lit(-1)).cast("long").alias("__to"), F.when(accepted, -F.col("__one.neg")).otherwise(F.col("__best")).alias("score"))
    known = distinct.join(mapping, "__key").select("__v", "__to", "score", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    return (
        rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
        .join(known, ["__v", "__salt"], "left")
        .select(*by, F.coalesce("__to", F.lit(-1).cast("long")).alias("ref_id"), "score")
    )
