"""Lexical and vector search over segments or windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators.closewords import close_pairs
from touchline.session import cut_lineage

K1, B = 1.2, 0.75


def plain(c: Column) -> Column:
    """The exact analyser: lower case, letters and digits."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def general(c: Column) -> Column:
    """The loose analyser: without accents as well."""
    return F.trim(F.regexp_replace(T.unaccented(F.regexp_replace(F.lower(c), "ø", "o")), r"[^a-z0-9]+", " "))


FIELDS = (("exact", plain, 2.0), ("loose", general, 1.0))


def _tokens(c: Column, analyse: Callable[[Column], Column]) -> Column:
    return F.filter(F.split(analyse(c), " "), lambda x: x != "")


def _fielded(terms: Column, field: int, dl: Column | None = None) -> Column:
    """The terms as structs with the number of their field, and ``dl``."""
    more = [] if dl is None else [dl.alias("dl")]
    return F.transform(terms, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term"), *more))


def allowed_edits(asked: Column, term: Column) -> Column:
    """Edits by which a term may differ from the asked one: one from three letters, two from six."""
    return F.when(asked >= 6, 2).when(asked >= 3, 1).otherwise(0)


def expanded(asked: DataFrame, vocabulary: DataFrame, fuzzy: bool = True) -> DataFrame:
    """field, asked, term, boost, df: the terms of the vocabulary that stand for an asked one.

    asked: field, asked, distinct.  vocabulary: field, term, df.  An expansion
    weighs 1 - edits / shorter length and counts as frequent as the most
    frequent one, as a misspelling must not outweigh the word it stands for.
    """
    if fuzzy:
        words = vocabulary.select(F.col("term").alias("b")).distinct()
        pairs = close_pairs(asked.select(F.col("asked").alias("a")).distinct(), words, allowed_edits, 2)
        near = asked.join(pairs, asked["asked"] == pairs["a"]).join(vocabulary.select("field", F.col("term").alias("b"), "df"), ["field", "b"]).withColumnRenamed("b", "term")
        terms = near.withColumn("boost", 1 - F.col("d") / F.least(F.length("asked"), F.length("term")))
    else:
        terms = asked.join(vocabulary.select("field", F.col("term").alias("asked"), F.col("term"), "df"), ["field", "asked"]).withColumn("boost", F.lit(1.0))
    most = F.max("df").over(Window.partitionBy("field", "asked"))
    return terms.select("field", "asked", "term", "boost", most.alias("df"))


def lexical_search(
    docs: DataFrame, queries: DataFrame, doc_id: str, text: str, group: str, top: int = 5, fuzzy: bool = True, phrase_boost: float = 5.0, min_score: float | None = None, most_broadcast: int = 1_000_000, together: int = 1000,
) -> DataFrame:
    """[M14, P8] The best ``top`` documents of each group for each query (qid, query): qid, group, doc_id, score, n.

    The better of twice the exact field's and once the loose field's BM25,
    plus ``phrase_boost`` for each field that has the whole query as a phrase.

    The documents are read twice: once for the vocabulary with its counts, once
    for the scores.  A group's documents meet all queries in parts of about
    ``together``, each by a matrix product, and only the best of a part leave
    it: words that many queries ask make no rows.  Terms, asked words and the
    members of distinct sets of queries that ask the same words travel to the
    tasks up to ``most_broadcast`` each; above it all meet by shuffles.
    """
    queries = cut_lineage(queries.select("qid", "query"))
    asked = queries.select("qid", F.explode(F.concat(*[_fielded(F.array_distinct(_tokens(F.col("query"), f)), i) for i, (_, f, _) in enumerate(FIELDS)])).alias("x")).select("qid", F.col("x.field").alias("field"), F.col("x.term").alias("asked"))
    said = docs.select(F.col(doc_id).alias("__d"), F.col(group).alias("__g"), *[_tokens(F.col(text), f).alias(f"__{name}") for name, f, _ in FIELDS])
    # one more entry a document and field, of no term, counts documents and tokens, and one a document those of its group
    own = F.array(F.struct(F.lit(len(FIELDS)).alias("field"), F.col("__g").cast("string").alias("term"), F.lit(0).alias("dl")))
    words = said.select(F.explode(F.concat(*[
        F.when(F.size(f"__{name}") > 0, F.concat(_fielded(F.array_distinct(f"__{name}"), i, F.lit(0)), F.array(F.struct(F.lit(i).alias("field"), F.lit("").alias("term"), F.size(f"__{name}").alias("dl"))))).otherwise(F.slice(_fielded(F.col(f"__{name}"), i, F.lit(0)), 1, 0))
        for i, (name, _, _) in enumerate(FIELDS)
    ], own)).alias("x"))
    counts = cut_lineage(words.groupBy(F.col("x.field").alias("field"), F.col("x.term").alias("term")).agg(F.count("*").alias("df"), F.sum("x.dl").alias("dl")))
    vocabulary = counts.where(F.col("field") < len(FIELDS))
    size = vocabulary.where("term = ''").select("field", F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    terms = cut_lineage(expanded(asked.select("field", "asked").distinct(), vocabulary.where("term <> ''"), fuzzy).join(F.broadcast(size), "field"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.select("field", "asked", "term", "boost", (F.col("boost") * idf).alias("idf"), "avgdl")
    if all(x.limit(most_broadcast + 1).count() <= most_broadcast for x in (terms, queries)) and (sets := _asking_sets(queries, asked, most_broadcast)):
        # at most one row for ``together`` documents
        large = counts.where((F.col("field") == len(FIELDS)) & (F.col("df") > together)).select(F.col("term").alias("__s"), F.ceil(F.col("df") / together).alias("__k"))
        out = _scored_in_parts(docs.select(F.col(doc_id).alias("__d"), F.col(group).alias("__g"), F.col(text).alias("__x")), *sets, weights, large, top, phrase_boost)
    else:
        out = _scored_by_joins(docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__x")), said, queries, asked, weights, phrase_boost)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    w = Window.partitionBy("qid", "__g").orderBy(F.desc(F.round("score", 9)), "__d")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select("qid", F.col("__g").alias(group), F.col("__d").alias(doc_id), "score", "n")


def _scored_by_joins(docs: DataFrame, said: DataFrame, queries: DataFrame, asked: DataFrame, weights: DataFrame, phrase_boost: float) -> DataFrame:
    """qid, __d, __g, score of each query and document with one of its terms.  Texts are looked at again only where all terms of a query stand."""
    tokens = said.select("__d", "__g", F.explode(F.concat(*[_fielded(F.col(f"__{name}"), i, F.size(f"__{name}")) for i, (name, _, _) in enumerate(FIELDS)])).alias("x")).select("__d", "__g", "x.*")
    hit = tokens.join(weights.select("field", "term").distinct(), ["field", "term"], "left_semi").groupBy("__d", "__g", "field", "term", "dl").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = hit.join(weights, ["field", "term"]).groupBy("__d", "__g", "field", "asked").agg(F.max(part).alias("part"), F.max(F.col("boost") == 1).alias("exactly"))
    wanted = asked.groupBy("qid", "field").agg(F.count("*").alias("terms"))
    sums = best.join(asked, ["field", "asked"]).groupBy("qid", "__d", "__g", "field").agg(F.sum("part").alias("s"), F.count_if("exactly").alias("found"))
    scored = sums.join(wanted, ["qid", "field"]).groupBy("qid", "__d", "__g").agg(
        F.greatest(*[F.coalesce(F.max(F.when(F.col("field") == i, F.col("s") * w)), F.lit(0.0)) for i, (_, _, w) in enumerate(FIELDS)]).alias("score"),
        F.max(F.col("found") == F.col("terms")).alias("whole"),
    )
    # a phrase can only stand where all its terms do
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    bonus = sum(F.when((f(F.col("query")) != "") & F.contains(pad(f(F.col("__x"))), pad(f(F.col("query")))), phrase_boost).otherwise(0.0) for _, f, _ in FIELDS)
    phrases = scored.where("whole").select("qid", "__d").join(docs, "__d").join(queries, "qid").select("qid", "__d", bonus.alias("__bonus"))
    return scored.join(phrases, ["qid", "__d"], "left").select("qid", "__d", "__g", (F.col("score") + F.coalesce("__bonus", F.lit(0.0))).alias("score"))


def _asking_sets(queries: DataFrame, asked: DataFrame, most: int) -> tuple[DataFrame, DataFrame] | None:
    """The queries numbered (i, qid, query), and the distinct sets of them (``who``, numbers) with the words (field, asked) each asks; None if words or members are more than ``most``."""
    numbered = cut_lineage(queries.where("qid is not null").withColumn("i", F.dense_rank().over(Window.orderBy("qid")) - 1))
    by = asked.join(numbered.select("i", "qid").distinct(), "qid").groupBy("field", "asked").agg(F.sort_array(F.collect_set("i")).alias("who"))
    sets = cut_lineage(by.groupBy("who").agg(F.collect_list(F.struct("field", "asked")).alias("words")))
    held = sets.agg(F.coalesce(F.sum(F.size("who")), F.lit(0)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    return (numbered, sets) if max(held) <= most else None


def _scored_in_parts(docs: DataFrame, queries: DataFrame, sets: DataFrame, weights: DataFrame, large: DataFrame, top: int, phrase_boost: float) -> DataFrame:
    """qid, __d, __g, score of the ``top`` documents of each part of a group for each query, the parts of large groups numbered by ``large`` (__s, __k)."""
    sides = [f(F.col("query")).alias(name) for name, f, _ in FIELDS]
    rows = [x.toArrow() for x in (queries.select("i", "qid", *sides), sets, weights.select("field", "asked", "term", "idf", F.col("boost") == 1, "avgdl"))]
    held = docs.sparkSession.sparkContext.broadcast(_asked_index(*rows))
    part = F.pmod(F.xxhash64("__d"), F.coalesce("__k", F.lit(1))).alias("__p")
    placed = docs.where("__x is not null").join(F.broadcast(large), F.col("__g").cast("string").eqNullSafe(F.col("__s")), "left")
    placed = placed.select("__g", part, "__d", *[f(F.col("__x")).alias(f"__{name}") for name, f, _ in FIELDS]).repartition("__g", "__p").sortWithinPartitions("__g", "__p")
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *docs.schema]}
    return placed.mapInArrow(_best_documents(held, top, phrase_boost), f"qid {kinds['qid']}, __d {kinds['__d']}, __g {kinds['__g']}, score double")


def _starts(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0 to n - 1 begins in ``at``, which is in order, and the end."""
    return np.searchsorted(at, np.arange(n + 1))


def _asked_index(queries: pa.Table, sets: pa.Table, weights: pa.Table) -> tuple[pa.Array, list[dict]]:
    """The queries' ids, and by field: ``phrase`` of each query, its number of words (``wanted``), the terms with the asked words they stand for, each asked word's set of queries, the sets' queries."""
    ids = queries.sort_by("i")["qid"].combine_chunks().unique()
    who = sets["who"].combine_chunks()
    members, n = who.flatten().to_numpy().astype(np.int64), pa.compute.list_value_length(who).to_numpy(zero_copy_only=False).astype(np.int64)
    in_set, words = np.repeat(np.arange(len(n)), n), sets["words"].to_pylist()
    fields = []
    for i, (name, _, _) in enumerate(FIELDS):
        phrase = [""] * len(ids)
        for at, text in zip(queries["i"].to_pylist(), queries[name].to_pylist()):
            phrase[at] = text or ""
        own = [(x["asked"], k) for k, listed in enumerate(words) for x in listed if x["field"] == i]
        number = {w: j for j, (w, _) in enumerate(own)}
        set_of = np.array([k for _, k in own], np.int64)
        asking = np.bincount(set_of, minlength=len(n))
        by = weights.filter(pa.compute.equal(weights["field"], i))
        position = {t: k for k, t in enumerate(by["term"].combine_chunks().unique().to_pylist())}
        term = np.array([position[t] for t in by["term"].to_pylist()], np.int64)
        stands = np.argsort(term, kind="stable")
        known = [number.get(w, -1) for w in by["asked"].to_pylist()]
        fields.append({
            "phrase": phrase, "wanted": np.bincount(members, weights=asking[in_set], minlength=len(ids)), "queries": members, "set_starts": _starts(in_set, len(n)), "set_of": set_of,
            "position": position, "starts": _starts(term[stands], len(position)), "asked": np.array(known, np.int64)[stands],
            "idf": by["idf"].to_numpy()[stands], "exactly": by.column(4).to_numpy().astype(bool)[stands], "avgdl": by["avgdl"][0].as_py() if by.num_rows else 1.0,
        })
    return ids, fields


def _spread(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at`` the places from its start to the next: the index in ``at``, and the place."""
    n = starts[at + 1] - starts[at]
    of = np.repeat(np.arange(len(at)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[at][of]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group and part, which follow each other."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        g, p = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(p)]
        for lo, hi in zip(edges, edges[1:]):
            at = (batch.column(0)[lo].as_py(), p[lo])
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            last = at
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _part_scores(field: dict, texts: pa.Array, doc: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of one field and part: sums by set of queries and document, how many of its words stand there exactly, and (queries, rows of these) in order of the queries."""
    tokens = pa.compute.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = tokens.flatten().dictionary_encode()
    known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    full = np.array([t != "" for t in known], bool)[code]
    dl = np.bincount(row[full], minlength=len(texts))
    term = np.array([field["position"].get(t, -1) for t in known], np.int64)[code]
    row, term = row[term >= 0], term[term >= 0]
    # rows of one document and length count as one text
    units, unit = np.unique(np.stack([doc, dl], axis=1), axis=0, return_inverse=True)
    key, tf = np.unique(unit.reshape(-1)[row] * max(len(field["position"]), 1) + term, return_counts=True)
    of, term = np.divmod(key, max(len(field["position"]), 1))
    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * units[of, 1] / field["avgdl"]))
    hit, place = _spread(field["starts"], term)
    hit, place = hit[field["asked"][place] >= 0], place[field["asked"][place] >= 0]
    asked, at = np.unique(field["asked"][place], return_inverse=True)
    score, exactly = np.zeros((len(asked), n)), np.zeros((len(asked), n))
    where = (at, units[of[hit], 0])
    np.maximum.at(score, where, field["idf"][place] * share[hit])
    np.maximum.at(exactly, where, field["exactly"][place].astype(float))
    sets, at = np.unique(field["set_of"][asked], return_inverse=True)
    order, starts = np.argsort(at, kind="stable"), _starts(np.sort(at), len(sets))[:-1]
    if len(sets):
        score, exactly = (np.add.reduceat(x[order], starts, axis=0) for x in (score, exactly))
    of, place = _spread(field["set_starts"], sets)
    who = field["queries"][place]
    order = np.argsort(who, kind="stable")
    return score, exactly, who[order], of[order]


def _best_documents(held, top: int, phrase_boost: float, block: int = 512):
    """The ``top`` documents of each part for each query of ``_asked_index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fields = held.value
        for part in _parts(batches):
            found = part["__d"].combine_chunks()
            docs = found.unique()
            docs = docs.take(pa.compute.sort_indices(docs, null_placement="at_start"))
            doc = pa.compute.index_in(found, docs).to_numpy().astype(np.int64)
            texts = [part[f"__{name}"].combine_chunks() for name, _, _ in FIELDS]
            scores = [_part_scores(f, x, doc, len(docs)) for f, x in zip(fields, texts)]
            for lo in range(0, len(ids), block):
                total = np.zeros((min(block, len(ids) - lo), len(docs)))
                whole = np.zeros(total.shape, bool)
                for (_, _, weight), f, (score, exactly, who, rows) in zip(FIELDS, fields, scores):
                    a, b = np.searchsorted(who, [lo, lo + block])
                    asks = np.zeros((len(total), len(score)))
                    asks[who[a:b] - lo, rows[a:b]] = 1
                    np.maximum(total, asks @ score * weight, out=total)
                    wanted = f["wanted"][lo : lo + block]
                    able = np.flatnonzero((wanted > 0) & (wanted <= exactly.sum(axis=0).max(initial=0)))
                    whole[able] |= asks[able] @ exactly == wanted[able][:, None]
                # a phrase can only stand where all its terms do
                for q, d in zip(*np.nonzero(whole)):
                    for f, x in zip(fields, texts):
                        phrase = f["phrase"][lo + q]
                        if phrase and any(f" {phrase} " in f" {x[int(r)].as_py()} " for r in np.flatnonzero(doc == d)):
                            total[q, d] += phrase_boost
                order = np.argsort(-np.round(total, 9), axis=1, kind="stable")[:, :top] if top > 1 else np.argmax(np.round(total, 9), axis=1)[:, None]
                best = np.take_along_axis(total, order, 1)
                q, k = np.nonzero(best > 0)
                if len(q):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + lo)), docs.take(pa.array(order[q, k])), part["__g"].combine_chunks().take(pa.array(np.zeros(len(q), np.int64))), pa.array(best[q, k])], names=["qid", "__d", "__g", "score"])

    return run


def nearest_vectors(df: DataFrame, queries: DataFrame, vec_id: str, vector: str, top: int = 5, most_queries: int = 50_000, block: int = 2048) -> DataFrame:
    """[M15] query_id, vec_id, score, n: the ``top`` rows of highest cosine for each query, itself left out.

    A stated query set against all rows: the queries travel to the tasks,
    ``most_queries`` at a time (each such part is one pass over the rows), each
    batch of rows keeps its own best by one matrix product a block, and the
    batches' bests are merged.  Null and zero vectors, and vectors of another
    length than the table's commonest, match nothing.
    """
    asked = cut_lineage(queries.where(f"{vec_id} is not null and {vector} is not null").select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["i"]))
    shape = asked.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    width, parts = (int(shape["w"]), -(-int(shape["n"]) // most_queries)) if shape else (0, 1)
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == width) & F.col("i").isNotNull())
    out = None
    for p in range(parts):
        # hashed parts are about equal, so each stays near most_queries
        own = asked.where((F.size("v") == width) & (F.pmod(F.xxhash64("i"), F.lit(parts)) == p)).toPandas()
        ids = own["i"].to_numpy(np.int64)
        matrix = np.array(own["v"].tolist(), dtype=np.float64).reshape(len(own), width)
        norm = np.linalg.norm(matrix, axis=1)
        held = sc.broadcast((ids[norm > 0], matrix[norm > 0] / norm[norm > 0][:, None]))
        found = rows.mapInArrow(_best_of(held, width, top, block), "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return out.where("score > double('-infinity')").withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)


def _best_of(held, width: int, top: int, block: int):
    """For each batch of (id, vector) the best rows of each query held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column(0).to_numpy()
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            size = np.linalg.norm(m, axis=1)
            fine = np.isfinite(size) & (size > 0)
            own, m = own[fine], m[fine] / size[fine][:, None]
            k = min(top, len(own))
            for at in range(0, len(ids) if k else 0, block):
                s = matrix[at : at + block] @ m.T
                s[ids[at : at + block][:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at : at + block], k)), pa.array(own[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "vec_id", "score"]
                )

    return run


def summed(hits: Sequence[DataFrame], by: Sequence[str], top: int | None = None) -> DataFrame:
    """[M15] by, score, n: the hits of several searches with their scores added up; n orders each by[0]'s hits."""
    rows = None
    for h in hits:
        part = h.select(*by, "score")
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy(by[0]).orderBy(F.desc(F.round("score", 9)), *by[1:])
    out = rows.groupBy(*by).agg(F.sum("score").alias("score")).withColumn("n", F.row_number().over(w))
    return out if top is None else out.where(F.col("n") <= top)


def top_hits(hits: DataFrame, docs: DataFrame, doc_id: str, text: str, targets: DataFrame) -> DataFrame:
    """[A17, A18] Per category (first letter of qid): queries, share whose first hit has a target, mean first score."""
    first = hits.where("n = 1").join(docs.select(doc_id, F.col(text).alias("__text")), doc_id).join(targets, "qid")
    hit = T.first_target(F.col("__text"), F.col("targets")).isNotNull()
    return first.groupBy(F.substring("qid", 1, 1).alias("category")).agg(F.count("*").alias("queries"), F.avg(hit.cast("double")).alias("hit_rate"), F.avg("score").alias("mean_score"))


def compared_runs(first: DataFrame, second: DataFrame, docs: DataFrame, doc_id: str, text: str, targets: DataFrame, names: tuple[str, str] = ("raw", "cleaned")) -> DataFrame:
    """[A18, K10] run, queries, hit_rate, mean_score of two searches, and the row 'delta' with their differences and relative (percent of the first's mean score)."""

    def sums(hits: DataFrame, name: str) -> DataFrame:
        t = top_hits(hits, docs, doc_id, text, targets)
        whole = t.agg(F.sum("queries").alias("queries"), (F.sum(F.col("hit_rate") * F.col("queries")) / F.sum("queries")).alias("hit_rate"), (F.sum(F.col("mean_score") * F.col("queries")) / F.sum("queries")).alias("mean_score"))
        return whole.select(F.lit(name).alias("run"), "queries", "hit_rate", "mean_score", F.lit(None).cast("double").alias("relative"))

    a, b = sums(first, names[0]), sums(second, names[1])
    x, y = a.select(F.struct("*").alias("x")), b.select(F.struct("*").alias("y"))
    change = x.join(y).select(
        F.lit("delta").alias("run"), (F.col("y.queries") - F.col("x.queries")).alias("queries"), (F.col("y.hit_rate") - F.col("x.hit_rate")).alias("hit_rate"), (F.col("y.mean_score") - F.col("x.mean_score")).alias("mean_score"),
        F.when(F.col("x.mean_score") != 0, (F.col("y.mean_score") - F.col("x.mean_score")) / F.col("x.mean_score") * 100).otherwise(0.0).alias("relative"),
    )
    return a.unionByName(b).unionByName(change)
