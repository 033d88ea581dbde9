"""Order-dependent operators on segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.functions.similarity import indel_ratio, indel_ratio_of
from touchline.operators.ordered import KEY, entity, fold_groups, millis, plain_key, with_last_flag, with_previous, with_rank, with_running_max
from touchline.session import cut_lineage


def merge_near_duplicates(df: DataFrame, keys: Sequence[str], row_id: str, start: str, end: str, tie: str, text: str, threshold: float = 95.0, carry: Sequence[str] = ()) -> DataFrame:
    """[W1] Successive rows as similar to the kept anchor as ``threshold`` are merged into it.

    Returns keys, row_id, kept (boolean), duplicate_of, similarity, end_time
    (of a kept row: the latest of what it took in), and the columns in ``carry``.

    Each row is compared with the anchor, not with its predecessor, which is a
    fold.  But a run of equal texts is decided by its first row, so only first
    rows are folded, and a loop of any length is one.  And two rows both within
    the threshold of one anchor are within twice that distance of each other
    (the Indel distance is a metric), so a fold can't cross a pair of
    neighbours less similar than that.  Only the short stretches between such
    breaks are folded, each by itself.
    """
    src = df.select(
        entity(keys), F.col(row_id).alias("__id"), millis(start).alias("__t"), F.col(tie).alias("__tie"), F.col(end).alias("__e"),
        F.coalesce(T.dedup_key(F.lower(F.col(text))), F.lit("")).alias("__x"), F.struct(F.lit(0).alias("__"), *carry).alias("__carry"),
    )
    first = F.coalesce((F.col("__before") != F.col("__x")) | (F.col("__x") == ""), F.lit(True))
    ranked = cut_lineage(with_previous(with_rank(src, "__t", ["__tie", "__id"]), F.col("__x"), "__before").withColumn("__first", first))
    heads = ranked.where("__first").select(KEY, "__rank", "__id", "__x", "__before")
    share = threshold / 100  # neighbours of one anchor: d <= (1 - t) * (l + 2 a + m), and a <= l (2 - t) / t
    bound = 100 * (1 - 2 * (1 - share) / share) - 1e-9
    near = F.when(F.col("__before").isNotNull() & (200 * F.least(F.length("__x"), F.length("__before")) >= bound * (F.length("__x") + F.length("__before"))), indel_ratio(F.col("__before"), F.col("__x")))
    island = cut_lineage(with_last_flag(heads.withColumn("__near", near), F.coalesce(F.col("__near") < bound, F.lit(True)), "__island").drop("__near", "__before"))

    def fold(stretch: list[tuple]) -> list[tuple]:
        anchor, rows = None, []
        for kid, rank, own, x, _ in stretch:
            same = indel_ratio_of(anchor[1], x) if anchor is not None and anchor[1] and x else 0.0
            if anchor is not None and same >= threshold:
                rows.append((kid, rank, False, anchor[0], same, anchor[2]))
            else:
                anchor = (own, x, rank)
                rows.append((kid, rank, True, None, None, rank))
        return rows

    sizes = island.groupBy(KEY, "__island").agg(F.count("*").alias("__n")).where("__n > 1").select(KEY, "__island")
    several = island.join(sizes, [KEY, "__island"], "left_semi").withColumn("__kid", F.to_json(KEY))
    done = fold_groups(
        several.select("__kid", "__rank", F.col("__id").cast("string").alias("__id"), "__x", "__island"), ["__kid", "__island"], ["__rank"], fold,
        [("__kid", "string"), ("__rank", "long"), ("kept", "boolean"), ("duplicate_of", "string"), ("similarity", "double"), ("__anchor", "long")],
    )
    told = island.withColumn("__kid", F.to_json(KEY)).join(done, ["__kid", "__rank"], "left").select(
        KEY, "__rank", F.struct("__rank", F.col("__id").cast("string").alias("id"), F.coalesce("kept", F.lit(True)).alias("kept"), "duplicate_of", "similarity", F.coalesce("__anchor", "__rank").alias("anchor")).alias("__head")
    )
    # rows behind the first of their run take what it was told
    every = with_running_max(ranked.drop("__before", "__x").join(told, [KEY, "__rank"], "left"), F.col("__head"), "__of")
    every = cut_lineage(every.drop("__head"))
    ends = every.groupBy(KEY, F.col("__of.anchor").alias("__rank")).agg(F.max("__e").alias("__end"))
    head, kept = F.col("__first"), F.col("__of.kept")
    return every.join(ends, [KEY, "__rank"], "left").select(
        *[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.col("__id").alias(row_id), (head & kept).alias("kept"),
        F.when(~kept, F.col("__of.duplicate_of")).when(~head, F.col("__of.id")).alias("duplicate_of"), F.when(~kept, F.col("__of.similarity")).when(~head, F.lit(100.0)).alias("similarity"),
        F.when(head & kept, F.coalesce("__end", "__e")).otherwise(F.col("__e")).alias("end_time"), *[F.col(f"__carry.{c}").alias(c) for c in carry],
    )


def merge_equal_neighbours(df: DataFrame, keys: Sequence[str], row_id: str, start: str, end: str, tie: str, text: str) -> DataFrame:
    """[W1, equality] Runs of equal normalised texts: keys, first row_id, end_time, n.  Transitive, so gaps and islands suffice."""
    src = df.select(entity(keys), F.col(row_id).alias("__id"), millis(start).alias("__t"), F.col(tie).alias("__tie"), F.col(end).alias("__e"), F.coalesce(T.dedup_key(F.lower(F.col(text))), F.lit("")).alias("__x"))
    ranked = with_previous(with_rank(src, "__t", ["__tie", "__id"]), F.col("__x"), "__before")
    island = with_last_flag(ranked, F.coalesce((F.col("__before") != F.col("__x")) | (F.col("__x") == ""), F.lit(True)), "__island")
    out = island.groupBy(KEY, "__island").agg(F.min_by("__id", "__rank").alias("__id"), F.max("__e").alias("end_time"), F.count("*").alias("n"))
    return plain_key(out, keys, [F.col("__id").alias(row_id), "end_time", "n"])


def lone_name(c: Column) -> Column:
    """[W2] The lower-cased single capitalised word a text consists of, else null."""
    t = T.dedup_key(c)
    w = T.words(t)
    one = (F.size(w) == 1) & t.rlike(r"^\p{Lu}") & ~T.is_all_upper(t) & t.rlike(r"\p{L}")
    return F.when(one, F.lower(t))


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """Adds __start: the rank of the first row of the greedy cluster a row is in.

    rows: KEY, __rank (dense), __t.  A cluster begins at rank 0 and at the first
    row more than ``window`` after the beginning before it.  Each row's next
    beginning, were it one itself, is found by ranking rows and ends of windows
    together; from rank 0 on, the beginnings are marked by pointer doubling:
    each round marks what the marked point to, and doubles all pointers.
    """
    both = rows.select(KEY, "__rank", F.col("__t").alias("__at"), F.lit(0).alias("__probe")).unionByName(rows.select(KEY, "__rank", (F.col("__t") + window).alias("__at"), F.lit(1).alias("__probe")))
    placed = with_rank(both, "__at", ["__probe", "__rank"], out="__place")
    # rows up to the end of the window: all places before less the probes there
    jump = placed.where("__probe = 1").select(KEY, "__rank", (F.col("__place") - F.col("__rank")).alias("to"))
    jump = cut_lineage(jump.join(rows.select(KEY, F.col("__rank").alias("to")), [KEY, "to"], "left_semi").select(KEY, "__rank", "to"))
    marked = rows.where("__rank = 0").select(KEY, "__rank")
    while not jump.isEmpty():
        marked = cut_lineage(marked.unionByName(marked.join(jump, [KEY, "__rank"]).select(KEY, F.col("to").alias("__rank"))).distinct())
        jump = cut_lineage(jump.join(jump.select(KEY, F.col("__rank").alias("to"), F.col("to").alias("next")), [KEY, "to"]).select(KEY, "__rank", F.col("next").alias("to")))
    flagged = rows.join(marked.withColumn("__mark", F.lit(True)), [KEY, "__rank"], "left")
    return with_last_flag(flagged, F.coalesce("__mark", F.lit(False)), "__start").drop("__mark")


def stuck_names(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], start: str, text: str, least: int = 3, window_s: float = 60.0) -> DataFrame:
    """[W2] Rows of clusters of ``least`` or more equal single names within ``window_s`` of the cluster's first.

    Clusters are greedy and anchored at their first row.  A gap wider than the
    window always starts a new one; a stretch between such gaps that is no
    longer than the window is one cluster, in others the beginnings are found
    by pointer doubling, so a word stuck for hours is no single task.  Times
    count in whole milliseconds.  Returns keys, row_id..., token.
    """
    window = round(window_s * 1000)
    src = df.select(F.struct(*[F.col(k).alias(k) for k in keys], lone_name(F.col(text)).alias("token")).alias(KEY), *row_id, millis(start).alias("__t")).where(F.col(f"{KEY}.token").isNotNull() & F.col("__t").isNotNull())
    src = cut_lineage(src)  # few rows of many
    ranked = with_previous(with_rank(src, "__t", list(row_id)), F.col("__t"), "__before")
    island = cut_lineage(with_last_flag(ranked, F.coalesce(F.col("__t") - F.col("__before") > window, F.lit(True)), "__island").drop("__before"))
    spans = island.groupBy(KEY, "__island").agg(F.count("*").alias("__n"), (F.max("__t") - F.min("__t")).alias("__span")).where(F.col("__n") >= least)
    out = [*[F.col(f"{KEY}.{k}").alias(k) for k in keys], *row_id, F.col(f"{KEY}.token").alias("token")]
    short = island.join(spans.where(F.col("__span") <= window).select(KEY, "__island"), [KEY, "__island"], "left_semi").select(*out)
    wide = spans.where(F.col("__span") > window).select(KEY, "__island")
    if wide.isEmpty():
        return short
    # stretches as entities of their own, with ranks from 0
    long = island.join(wide, [KEY, "__island"], "left_semi").select(F.struct(KEY, "__island").alias(KEY), (F.col("__rank") - F.col("__island")).alias("__rank"), "__t", *row_id)
    placed = _anchored(long, window)
    full = placed.groupBy(KEY, "__start").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(KEY, "__start")
    stuck = placed.join(full, [KEY, "__start"], "left_semi").select(F.col(f"{KEY}.{KEY}").alias(KEY), *row_id)
    return short.unionByName(stuck.select(*out))


def select_spans(spans: Column) -> Column:
    """[W4] Greedy disjoint spans from array<struct<start,end,...>>: by start, longer first."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])).cast("int"))
    end = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, s: F.when(s["start"] >= end(acc), F.concat(acc, F.array(s))).otherwise(acc))


def splice(text: Column, edits: Column) -> Column:
    """[W5] Applies array<struct<start,end,new>> (offsets from 0) from the right, so that offsets stay valid."""
    ordered = F.reverse(F.array_sort(edits, lambda a, b: (a["start"] - b["start"]).cast("int")))
    return F.aggregate(ordered, text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["start"]), e["new"], F.substring(acc, e["end"] + 1, F.length(acc))))


def time_chunks(df: DataFrame, start: str, window_s: float = 12.0, slide_s: float = 8.0) -> DataFrame:
    """[W6] Each row in every window [k * slide, k * slide + window) with k >= 0 that holds its start; adds window_start."""
    last = F.floor(F.col(start) / slide_s)
    first = F.greatest(F.floor((F.col(start) - window_s) / slide_s) + 1, F.lit(0))
    return df.where(F.col(start) >= 0).withColumn("window_start", F.explode(F.transform(F.sequence(first, last), lambda k: k * slide_s)))


def count_windows(df: DataFrame, keys: Sequence[str], start: str, ties: Sequence[str], size: int = 5, step: int = 3) -> DataFrame:
    """[W7] Windows of ``size`` rows every ``step`` rows in order; adds window_no.  Short windows at the end stay."""
    base = df.select(entity(keys), "*").withColumn("__t", millis(start))
    ranked = with_rank(base, "__t", ties)
    i = F.col("__rank")
    first = F.greatest(F.ceil((i - (size - 1)) / step), F.lit(0))
    return ranked.withColumn("window_no", F.explode(F.sequence(first, F.floor(i / step)))).drop(KEY, "__t", "__rank")


def merge_hits(df: DataFrame, keys: Sequence[str], start: str, end: str, text: str, slack_s: float = 2.0) -> DataFrame:
    """[W8] Hits that overlap or lie ``slack_s`` apart become one: keys, start, end, n, texts (distinct, in order)."""
    src = df.select(entity(keys), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(text).alias("__x"), millis(start).alias("__t"))
    reach = with_running_max(with_rank(src, "__t", ["__s", "__e", "__x"]), F.col("__e"), "__reach", before=True)
    island = with_last_flag(reach, F.coalesce(F.col("__s") > F.col("__reach") + slack_s, F.lit(True)), "__i")
    merged = island.groupBy(KEY, "__i").agg(
        F.min("__s").alias(start), F.max("__e").alias(end), F.count("*").alias("n"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("__rank", "__x"))), lambda x: x["__x"])).alias("texts"),
    )
    return plain_key(merged, keys, [start, end, "n", "texts"])


def frozen_positions(words: Column, names: Column) -> Column:
    """[W9] Positions (from 0) of the words that applied names stand on: for each word of each name the first free match."""
    bare = lambda x: F.lower(T.strip_chars(x, T.EDGE_PUNCT))
    want = F.flatten(F.transform(names, lambda n: F.transform(T.words(n), bare)))

    def of(have: Column) -> Column:
        def step(acc, w):
            free = F.filter(F.sequence(F.lit(0), F.greatest(F.size(have) - 1, F.lit(0))), lambda i: (F.get(have, i) == w) & ~F.array_contains(acc, i))
            return T.let(free, lambda f: F.when(F.size(f) > 0, F.concat(acc, F.slice(f, 1, 1))).otherwise(acc))

        return F.aggregate(want, F.expr("cast(array() as array<int>)"), step)

    return T.let(F.transform(words, bare), of)
