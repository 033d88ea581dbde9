"""Text statistics per document, and the text type they tell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bytesview import CLASS, Words, buffers, per_text, slices
from touchline.llm.vocabulary import Vocabulary, learn_vocabulary, member
from touchline.session import cut_lineage

TYPES = ("prose", "list", "table", "junk")

# Labelling functions: a statistic, the upper bounds of its levels, and the
# types each level speaks for (p, l, t, j).
FUNCTIONS = (
    ("common_share", (0.1, 0.25, 0.5), ("ltj", "ltj", "pltj", "p")),
    ("cells_per_line", (0.5, 1.5), ("plj", "pltj", "t")),
    ("digit_ratio", (0.03, 0.12, 0.3), ("plj", "plt", "ltj", "tj")),
    ("words_per_line", (5.0, 12.0), ("lt", "pltj", "plj")),
    ("items_per_word", (0.15,), ("ptj", "l")),
    ("upper_share", (0.3, 0.7), ("pj", "ptj", "lt")),
    ("mean_word_length", (2.5, 9.0), ("j", "plt", "j")),
    ("symbol_ratio", (0.08, 0.25), ("pl", "lt", "tj")),
    ("punct_line_share", (0.2, 0.8), ("pltj", "p", "p")),
    ("known_share", (0.4, 0.65), ("j", "pltj", "plt")),
    ("mixed_share", (0.1, 0.3), ("plt", "pltj", "j")),
)
STATS = ("words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "known_share", "digit_ratio", "upper_share", "cells_per_line", "words_per_line", "items_per_word", "mixed_share", "lines")


def _at(raw: np.ndarray, pattern: bytes) -> np.ndarray:
    """Positions of a byte pattern."""
    n = len(raw) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(raw[:n] == pattern[0])
    for k, b in enumerate(pattern[1:], 1):
        hit = hit[raw[hit + k] == b]
    return hit


def text_stats(raw: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The STATS of each text; a text without words or lines has zeros."""
    n = len(offsets) - 1
    if not len(raw):
        return {k: np.zeros(n) for k in STATS}
    w = Words(raw, offsets)

    def text_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, at, side="right") - 1

    words = per_text(w.text, n)
    some = np.maximum(words, 1)
    # characters: bytes that don't continue another; spaces apart
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    char = ((raw & 0xC0) != 0x80) & ~space
    owner = np.repeat(np.arange(n), np.diff(offsets))
    chars = np.maximum(per_text(owner, n, char.astype(float)), 1)
    digits = per_text(owner, n, (CLASS[raw] == 2).astype(float))
    symbols = per_text(owner, n, (char & (w.kind == 0) & (CLASS[raw] != 2)).astype(float))
    letters = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(char & (w.kind == 1), out=letters[1:])
    lengths = letters[w.end] - letters[w.start]

    # lines with anything but spaces: their first and last visible byte
    visible = np.flatnonzero(~space)
    line = np.cumsum((raw == 10) | (raw == 13))[visible]
    vt = owner[visible]
    new = np.ones(len(visible), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (vt[1:] != vt[:-1])
    first = visible[new]
    last = visible[np.append(np.flatnonzero(new)[1:] - 1, len(visible) - 1)] if len(visible) else first
    lt = owner[first] if len(first) else np.zeros(0, np.int64)
    lines = per_text(lt, n)
    end = raw[last]
    back = raw[np.maximum(last - 1, 0)]
    quoted = np.isin(end, np.frombuffer(b"\"')", np.uint8))
    closes = np.isin(np.where(quoted, back, end), np.frombuffer(b".!?", np.uint8)) | ((end == 0xA6) & (back == 0x80))
    punct = per_text(lt, n, closes.astype(float)) / np.maximum(lines, 1)

    # cells: separators of columns; rows: lines, or rows of a markup table
    cells = np.zeros(n)
    for pattern in (b"\t", b"|", b'","', b"<td"):
        cells += per_text(text_of(_at(raw, pattern)), n)
    semicolon = _at(raw, b";")
    semicolon = semicolon[~space[np.minimum(semicolon + 1, len(raw) - 1)]]
    cells += per_text(text_of(semicolon), n)
    comma = _at(raw, b",")
    comma = comma[comma + 1 < len(raw)]
    cells += per_text(text_of(comma[CLASS[raw[comma + 1]] == 2]), n)
    wide = _at(raw, b"   ")
    wide = wide[(wide + 3 >= len(raw)) | (raw[np.minimum(wide + 3, len(raw) - 1)] != 32)]
    cells += per_text(text_of(wide), n)
    entities = _at(raw, b"&")
    rows = np.maximum(lines, per_text(text_of(_at(raw, b"<tr")), n))
    cells = np.maximum(cells - per_text(text_of(entities), n), 0) / np.maximum(rows, 1)

    # items: bullets, numbers before words, 'name: value', and separators within a line
    bullet = np.isin(raw[first], np.frombuffer(b"-*", np.uint8)) | ((raw[first] == 0xE2) & (raw[np.minimum(first + 1, len(raw) - 1)] == 0x80))
    number = (CLASS[raw[first]] == 2) & (CLASS[raw[last]] == 1)
    value = (CLASS[raw[last]] == 2) | (raw[last] == 41)
    items = per_text(lt, n, (bullet | number | value).astype(float))
    for pattern in (b", ", b" / ", b"; "):
        items += per_text(text_of(_at(raw, pattern)), n)

    # one item a line has no columns beside it
    items[cells >= 1.5] = 0

    return {
        "words": words.astype(float),
        "mean_word_length": per_text(w.text, n, lengths.astype(float)) / some,
        "symbol_ratio": symbols / chars,
        "punct_line_share": punct,
        "common_share": per_text(w.text, n, member(w.hash, vocabulary.common).astype(float)) / some,
        "known_share": per_text(w.text, n, member(w.hash, vocabulary.known).astype(float)) / some,
        "digit_ratio": digits / chars,
        "upper_share": per_text(w.text, n, w.upper.astype(float)) / some,
        "cells_per_line": cells,
        "words_per_line": words / np.maximum(rows, 1),
        "items_per_word": items / some,
        "mixed_share": per_text(w.text, n, w.touches_digit().astype(float)) / some,
        "lines": lines.astype(float),
    }


def levels(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One number per text for the levels of all labelling functions."""
    code = np.zeros(len(stats["words"]), dtype=np.int64)
    for name, bounds, _ in FUNCTIONS:
        code = code * (len(bounds) + 1) + np.searchsorted(np.array(bounds), stats[name], side="right")
    return code


def is_prose(stats: dict[str, np.ndarray], common_share: float = 0.5, mixed_share: float = 0.2) -> np.ndarray:
    """Whether half of the words are common ones and few touch digits: the two surest functions alone."""
    return (stats["common_share"] >= common_share) & (stats["mixed_share"] < mixed_share)


def document_stats(df: DataFrame, row_id: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """row_id, blank, pattern and STATS of every row; null texts are blank with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                s = text_stats(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(levels(s)), *[pa.array(s[k]) for k in STATS]],
                    names=["row_id", "blank", "pattern", *STATS],
                )

    blank = ~F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"), blank.alias("blank"))
    return rows.mapInArrow(run, "row_id long, blank boolean, pattern long, " + ", ".join(f"{k} double" for k in STATS))


def learn_types(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, trust: float = 0.01) -> tuple[np.ndarray, list[np.ndarray]]:
    """Posterior of the TYPES by pattern, and each function's level rates by type.

    Expectation-maximisation of a latent class model: the type of a text is
    hidden, the levels of the functions are independent given it.  It starts
    from what each level speaks for; that start also stays as ``trust`` of the
    texts' number in pseudo-counts, so that no type changes its meaning.
    """
    sizes = [len(b) + 1 for _, b, _ in FUNCTIONS]
    level = np.zeros((len(patterns), len(sizes)), dtype=np.int64)
    rest = patterns.copy()
    for f in range(len(sizes) - 1, -1, -1):
        level[:, f] = rest % sizes[f]
        rest //= sizes[f]
    start = []
    for _, _, speaks in FUNCTIONS:
        t = np.array([[1.0 if kind[0] in s else 0.04 for s in speaks] for kind in TYPES])
        start.append(t / t.sum(axis=1, keepdims=True))
    rates, prior = start, np.array([0.85, 0.05, 0.05, 0.05])
    n = counts.sum()
    post = np.zeros((len(patterns), len(TYPES)))
    for _ in range(rounds):
        log = np.log(prior)[None, :] + sum(np.log(r[:, level[:, f]]).T for f, r in enumerate(rates))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (n + len(TYPES))
        rates = []
        for f, s in enumerate(start):
            seen = np.stack([np.bincount(level[:, f], weights=weight[:, t], minlength=s.shape[1]) for t in range(len(TYPES))])
            seen = seen + s * (1 + trust * n)
            rates.append(seen / seen.sum(axis=1, keepdims=True))
    return post, rates


def text_types(df: DataFrame, row_id: str, text: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """row_id, kind, confidence, p_prose, p_list, p_table, p_junk, blank and STATS.

    One pass computes the statistics and their pattern of levels (see
    FUNCTIONS); the patterns' counts, bounded by the product of the level
    numbers, go to the driver, where expectation-maximisation learns how far
    each function is to be trusted; the posterior of its pattern is a text's.

    Defined results: null and blank texts have kind null and confidence 0; of
    equal posteriors the first of TYPES wins; an empty table gives no rows;
    repeated rows are kept; other columns are ignored.
    """
    vocabulary = vocabulary or learn_vocabulary(df, text)
    stats = cut_lineage(document_stats(df, row_id, text, vocabulary))
    seen = stats.where("not blank").groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    patterns, counts = seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(float)
    post, _ = learn_types(patterns, counts) if len(patterns) else (np.zeros((0, 4)), [])
    kinds = [(int(p), TYPES[int(np.argmax(q))], float(q.max()), *map(float, q)) for p, q in zip(patterns, post)]
    table = df.sparkSession.createDataFrame(kinds, "pattern long, kind string, confidence double, p_prose double, p_list double, p_table double, p_junk double")
    # at most as many rows as there are patterns
    joined = stats.join(F.broadcast(table), "pattern", "left")
    seen_ = ~F.col("blank")
    return joined.select(
        "row_id", F.when(seen_, F.col("kind")).alias("kind"), F.when(seen_, F.col("confidence")).otherwise(0.0).alias("confidence"),
        *[F.when(seen_, F.col(c)).alias(c) for c in ("p_prose", "p_list", "p_table", "p_junk")], "blank", *STATS,
    )
