"""Language of documents, paragraphs and segments by prediction by partial matching.

Each language has a context tree over the bytes of its words (lower case, a 0
before and after): for every context of up to ORDER bytes how often each byte
followed.  A byte's probability is c / (n + d) in the longest context that has
it, times the escape d / (n + d) of each longer one (n bytes, d different ones
seen there).  The statistics are frozen after fitting, so the code length of a
word is a constant and is computed once for each distinct word of a batch.

Names say little about the language around them.  One more tree, of the
capitalised words of all languages together, stands for them: a word's code is
the mixture of its language's tree and that one, the latter with a weight that
depends on whether the word has a capital, and, with a small weight, of the
shortest code any tree has for it, so that one word (a shout of a thousand
letters) says no more than that weight's ten bits.  A text's code is that of its
distinct words: a loop must not outvote what is said once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.bytesview import Words, buffers, per_text, slices
from touchline.llm.repetition import prose_once, repeats, with_prose
from touchline.llm.vocabulary import Vocabulary, member

ORDER = 4
NOISE = 2.0**-10  # weight of a word's shortest code by any tree, under every language
NAMES_CAPITAL, NAMES_SMALL = 0.5, 0.02  # weight of the tree of names in words with and without a capital

# How the languages are written in labels, lower case, before any '-' or '_'.
SPELLINGS = {
    "en": ("en", "eng", "english", "engelsk", "engelska", "englisch", "anglais", "ingles", "inglés"),
    "sv": ("sv", "swe", "swedish", "svensk", "svenska", "schwedisch", "suédois", "sueco"),
    "no": ("no", "nor", "nob", "nno", "nb", "nn", "norwegian", "norsk", "norwegisch", "norvégien", "noruego"),
    "de": ("de", "deu", "ger", "german", "deutsch", "tysk", "tyska", "allemand", "alemán"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spansk", "spanska", "spanisch", "espagnol"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "fransk", "franska", "französisch", "francés"),
}


def language_code(label: Column, spellings: Mapping[str, Sequence[str]] = SPELLINGS) -> Column:
    """The code a label spells, null if it names none of the languages."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^\-_ (]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in spellings.items():
        out = F.when(head.isin(*names), F.lit(code)).otherwise(out)
    return out


def _grams(w: Words, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words at these places, each with the ``order`` before it as one number (a 0 ends each word), and the word of each."""
    size = w.end[at] - w.start[at]
    wide = size + order + 1
    stop = np.cumsum(wide)
    stream = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(at)), wide)
    place = np.arange(len(stream)) - np.repeat(stop - wide, wide) - order
    letter = (place >= 0) & (place < size[owner])
    stream[letter] = w.fold[(w.start[at][owner] + place)[letter]]
    code = stream.copy()
    for k in range(1, order + 1):
        code[k:] |= stream[:-k] << np.uint64(8 * k)
    scored = place >= 0
    return code[scored], owner[scored]


def _low(code: np.ndarray, size: int) -> np.ndarray:
    return code & np.uint64((1 << 8 * size) - 1)


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the codes, and whether they are there."""
    if not len(sorted_codes):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


@dataclass(frozen=True)
class Model:
    """Frozen context trees, that of names last.

    orders[k]: the (context of k, byte) numbers any tree has seen and their
    bits by tree, the contexts of k and the bits of their escapes by tree.
    """

    languages: tuple[str, ...]
    orders: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]


def code_lengths(model: Model, code: np.ndarray) -> np.ndarray:
    """Bits of each (context of ORDER, byte) number under each tree, exact but for the rounding of 64-bit floats."""
    bits = np.zeros((len(code), len(model.languages) + 1))
    left = np.arange(len(code))
    for k in range(len(model.orders) - 1, -1, -1):
        grams, cost, contexts, escape = model.orders[k]
        at, there = _find(grams, _low(code[left], k + 1))
        bits[left[there]] += cost[at[there]]
        left = left[~there]
        at, there = _find(contexts, _low(code[left], k + 1) >> np.uint64(8))
        bits[left[there]] += escape[at[there]]
    bits[left] += 8.0  # seen nowhere: all bytes alike
    return bits


def fit_model(texts: Mapping[str, Sequence[str]], order: int = ORDER) -> Model:
    """Counts the words of each language's texts; the capitalised ones of all make the tree of names."""
    streams, names = [], []
    for code in texts:
        raw, offsets = buffers(pa.array(list(texts[code]), type=pa.large_string()))
        w = Words(raw, offsets)
        streams.append(_grams(w, np.arange(len(w)), order)[0])
        names.append(_grams(w, np.flatnonzero(w.upper), order)[0])
    streams.append(np.concatenate(names) if names else np.zeros(0, np.uint64))
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(order + 1):
        counted = [np.unique(_low(s, k + 1), return_counts=True) for s in streams]
        grams = np.unique(np.concatenate([g for g, _ in counted]))
        contexts = np.unique(grams >> np.uint64(8))
        cost, escape = np.zeros((len(grams), len(streams))), np.zeros((len(contexts), len(streams)))
        # a tree that hasn't seen the byte here escapes to the shorter context
        fallback = code_lengths(Model(tuple(texts), tuple(orders)), grams)
        owner, _ = _find(contexts, grams >> np.uint64(8))
        for t, (g, c) in enumerate(counted):
            mine, _ = _find(contexts, g >> np.uint64(8))
            n = np.bincount(mine, weights=c, minlength=len(contexts))
            d = np.bincount(mine, minlength=len(contexts))
            seen = n > 0
            escape[seen, t] = -np.log2(d[seen] / (n[seen] + d[seen]))
            cost[:, t] = fallback[:, t] + escape[owner, t]
            at, _ = _find(grams, g)
            cost[at, t] = -np.log2(c / (n + d)[mine])
        orders.append((grams, cost, contexts, escape))
    return Model(tuple(texts), tuple(orders))


def score(w: Words, n: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Code length in bits by text and language, and the number of bytes coded."""
    k = len(model.languages)
    if not len(w):
        return np.zeros((n, k)), np.zeros(n)
    with np.errstate(over="ignore"):
        key = w.hash * np.uint64(2) + w.upper  # a word with a capital is another one
    _, first, each = np.unique(key, return_index=True, return_inverse=True)
    code, owner = _grams(w, first, len(model.orders) - 1)
    trees = np.add.reduceat(code_lengths(model, code), np.searchsorted(owner, np.arange(len(first))), axis=0)
    weight = np.where(w.upper[first], NAMES_CAPITAL, NAMES_SMALL)[:, None]
    own, name = trees[:, :k], trees[:, k:]
    short = trees.min(axis=1, keepdims=True)
    with np.errstate(under="ignore"):
        bits = short - np.log2((1 - weight - NOISE) * np.exp2(short - own) + weight * np.exp2(short - name) + NOISE)
    # a word said again tells nothing new
    once = np.unique(w.text * np.int64(len(first)) + each)
    text, word = once // len(first), once % len(first)
    out = np.stack([per_text(text, n, bits[word, t]) for t in range(k)], axis=1)
    return out, per_text(text, n, (w.end - w.start + 1)[first][word].astype(float))


def decide(bits: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the shortest code, its lead over the next in bits, and its posterior."""
    order = np.sort(bits, axis=1)
    best = np.argmin(bits, axis=1)
    lead = order[:, 1] - order[:, 0]
    with np.errstate(under="ignore"):
        posterior = 1 / np.exp2(-np.minimum(bits - order[:, :1], 1000)).sum(axis=1)
    posterior[symbols == 0] = 0
    return best, lead, posterior


def fit_languages(df: DataFrame, row_id: str, text: str, label: str, per_language: int = 400, longest: int = 20_000, rounds: int = 2, vocabulary: Vocabulary | None = None, spellings: Mapping[str, Sequence[str]] = SPELLINGS) -> Model:
    """Fits the trees on a bounded sample of labelled rows.

    For each language of ``spellings`` the ``per_language`` rows with the smallest hash of
    their id among those whose label spells it, no longer than ``longest``
    characters; so the sample is spread over the table and at most
    ``per_language * longest`` characters a language reach the driver.  Labels
    may be wrong: after each round texts whose shortest code is another
    language are left out.  A language without rows is left out of the model.
    """
    rows = (
        df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), language_code(F.col(label), spellings).alias("code"))
        .where((F.length("text") >= 40) & (F.length("text") <= longest) & F.col("code").isNotNull())
    )
    # row_number() <= n is limited before the shuffle, so no language is gathered whole
    nth = F.row_number().over(Window.partitionBy("code").orderBy(F.abs(F.xxhash64("id")), "id", "text"))
    taken = rows.withColumn("n", nth).where(F.col("n") <= per_language).groupBy("code").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    texts = {r["code"]: r["texts"] for r in taken.collect()}
    texts = {c: texts[c] for c in spellings if texts.get(c)}
    if vocabulary is not None:
        texts = {c: _prose(t, vocabulary) or t for c, t in texts.items()}
    model = fit_model(texts)
    for _ in range(rounds):
        kept = {}
        for k, code in enumerate(model.languages):
            raw, offsets = buffers(pa.array(texts[code], type=pa.large_string()))
            best, lead, _ = decide(*score(Words(raw, offsets), len(offsets) - 1, model)) if len(model.languages) > 1 else (np.zeros(len(texts[code]), int), None, None)
            kept[code] = [t for t, b in zip(texts[code], best) if b == k] or texts[code]
        model = fit_model(kept)
    return model


def _prose(texts: list[str], vocabulary: Vocabulary) -> list[str]:
    raw, offsets = buffers(pa.array(texts, type=pa.large_string()))
    w = Words(raw, offsets)
    fine = prose_once(w, repeats(w), vocabulary)
    return [t for t, f in zip(texts, fine) if f]


PARAGRAPH_BREAK = r"(?:\r\n|\n|\r)[^\S\r\n]*(?:(?:\r\n|\n|\r)[^\S\r\n]*)+"


def score_texts(df: DataFrame, ids: list[str], text: str, model: Model, vocabulary: Vocabulary | None = None, lead_bits: float = 4.0) -> DataFrame:
    """ids, lang, confidence, lead, words, symbols, common, mixed of every text.

    ``lang`` is null where no symbol was scored or the shortest code leads by
    less than ``lead_bits``; ``common`` and ``mixed`` count words as
    ``is_prose`` sees them (0 without a vocabulary).  No shuffle.
    """
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(len(ids)))
            for i, j in slices(offsets):
                n = j - i
                w = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                words = per_text(w.text, n)
                if len(model.languages) > 1:
                    bits, symbols = score(w, n, model)
                    best, lead, sure = decide(bits, symbols)
                    known = (symbols > 0) & (lead >= lead_bits)
                    lang = pa.array(np.where(known, names[best], None), type=pa.string())
                else:
                    lead = sure = symbols = np.zeros(n)
                    lang = pa.nulls(n, pa.string())
                common = mixed = np.zeros(n)
                if vocabulary is not None and len(w):
                    common = per_text(w.text, n, member(w.hash, vocabulary.common).astype(float))
                    mixed = per_text(w.text, n, w.touches_digit().astype(float))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, n) for k in range(len(ids))), lang, pa.array(sure), pa.array(lead), *(pa.array(x.astype(np.int64)) for x in (words, symbols, common, mixed))],
                    names=[*ids, "lang", "confidence", "lead", "words", "symbols", "common", "mixed"],
                )

    rows = df.select(*ids, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    kept = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ids)
    return rows.mapInArrow(run, f"{kept}, lang string, confidence double, lead double, words long, symbols long, common long, mixed long")


def document_languages(df: DataFrame, row_id: str, text: str, label: str, model: Model, vocabulary: Vocabulary, prose_share: float = 0.5, mixed_share: float = 0.2, spellings: Mapping[str, Sequence[str]] = SPELLINGS) -> DataFrame:
    """Each paragraph of each document, with the language of the document.

    Returns row_id, label_code (null: missing or no language), part_no (from
    1), lang and confidence of the paragraph, doc_lang (the language of most
    words), doc_confidence (the share of words in it), doc_langs (how many
    languages its paragraphs have), prose (of its words that don't repeat).  A paragraph too short to decide
    takes the document's language.

    Defined results: null, blank and wordless documents give no rows; of two
    languages with equally many words the first by code is the document's;
    documents in which nothing could be decided have null languages; rows with
    equal id count once; other columns are ignored.
    """
    docs = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(label).alias("label")).where(r"text rlike '(?U)\\S'").groupBy("row_id").agg(F.min(F.struct("text", "label")).alias("x"))
    # a phrase may loop across paragraphs, so the whole text tells whether it is prose
    whole = with_prose(docs.select("row_id", language_code(F.col("x.label"), spellings).alias("label_code"), F.col("x.text").alias("text")), "text", vocabulary, prose_share, mixed_share)
    parts = F.filter(F.split(F.col("text"), PARAGRAPH_BREAK), lambda t: t.rlike(r"(?U)\S"))
    rows = whole.select("row_id", "label_code", "prose", F.posexplode(parts).alias("p", "part"))
    rows = rows.select("row_id", "label_code", "prose", (F.col("p") + 1).alias("part_no"), "part")
    scored = score_texts(rows, ["row_id", "label_code", "prose", "part_no"], "part", model)
    # a document's paragraphs meet once; they were one row before
    doc = scored.groupBy("row_id", "label_code", "prose").agg(
        F.sum("words").alias("n"),
        *[F.sum(F.when(F.col("lang") == c, F.col("words")).otherwise(0)).alias(f"n_{c}") for c in model.languages],
        F.collect_list(F.struct("part_no", "lang", "confidence")).alias("parts"),
    )
    votes = F.array(*[F.struct((-F.col(f"n_{c}")).alias("n"), F.lit(c).alias("lang")) for c in model.languages])
    top = F.array_min(votes)
    doc = doc.select(
        "row_id", "label_code", "parts", F.when(top["n"] < 0, top["lang"]).alias("doc_lang"), (-top["n"] / F.greatest("n", F.lit(1))).alias("doc_confidence"),
        F.size(F.filter(votes, lambda v: v["n"] < 0)).alias("doc_langs"), "prose",
    )
    return doc.select(
        "row_id", "label_code", "doc_lang", "doc_confidence", "doc_langs", "prose", F.explode("parts").alias("p")
    ).select("row_id", "label_code", F.col("p.part_no").alias("part_no"), F.coalesce("p.lang", "doc_lang").alias("lang"), F.col("p.confidence").alias("confidence"), "doc_lang", "doc_confidence", "doc_langs", "prose")
