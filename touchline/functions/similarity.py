"""String similarities Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time.

    Bits of ``row`` are the positions of ``b``; a cleared bit is a step of the
    LCS, as in the bit-vector formulation of Hyyrö.
    """
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def indel_ratio_of(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); 100 for two empty strings."""
    n = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / n if n else 100.0


def _pairs(f):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            seen: dict[tuple, float | None] = {}
            out = []
            for x, y in zip(a, b):
                if (x, y) not in seen:
                    seen[x, y] = None if x is None or y is None else f(x, y)
                out.append(seen[x, y])
            yield pd.Series(out, dtype="float64")

    return run


def indel_ratio(a: Column, b: Column) -> Column:
    """Null if either is null."""
    return F.pandas_udf(_pairs(indel_ratio_of), "double")(a, b)


def word_edits(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """[A9] Substitutions, insertions, deletions and hits of a cheapest alignment of two token lists.

    Of equally cheap alignments one with the most hits counts; cost and hits
    then fix the other three.  Rows of the programme are numpy vectors: the
    step along a row is a running minimum.
    """
    n, m = len(a), len(b)
    codes: dict[str, int] = {}
    x = [codes.setdefault(t, len(codes)) for t in a]
    y = np.array([codes.setdefault(t, len(codes)) for t in b], dtype=np.int64)
    unit = n + m + 1
    slope = unit * np.arange(m + 1, dtype=np.int64)
    row = slope.copy()
    for i, code in enumerate(x, 1):
        best = np.empty(m + 1, dtype=np.int64)
        best[0] = unit * i
        np.minimum(row[:-1] + np.where(y == code, -1, unit), row[1:] + unit, out=best[1:])
        row = np.minimum.accumulate(best - slope) + slope
    cost = -(-int(row[-1]) // unit)
    hits = cost * unit - int(row[-1])
    subs = n + m - 2 * hits - cost
    return subs, m - subs - hits, n - subs - hits, hits


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences, bit-parallel (Myers)."""
    if not a:
        return len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    top = 1 << (len(a) - 1)
    full = (1 << len(a)) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(d | plus), plus & d
        if up & top:
            score += 1
        if down & top:
            score -= 1
        up = (up << 1) | 1
        down <<= 1
        plus = (down | ~(d | up)) & full
        minus = up & d & full
    return score


def metaphone_of(word: str) -> str:
    """Consonant code of an English word after the published metaphone rules (main cases)."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    if not w:
        return ""
    if w[:2] in ("KN", "GN", "PN", "WR", "AE"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, n = [], len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    i = 0
    while i < n:
        c = w[i]
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and at(i - 1) == "M"):
                out.append("B")
        elif c == "C":
            if at(i + 1) == "H":
                out.append("X")
                i += 1
            elif w[i : i + 3] == "CIA":
                out.append("X")
            elif at(i + 1) in ("I", "E", "Y"):
                out.append("S")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if at(i + 1) == "G" and at(i + 2) in ("E", "I", "Y") else "T")
        elif c == "G":
            if at(i + 1) == "H" and not (i + 2 < n and at(i + 2) in "AEIOU"):
                pass
            elif at(i + 1) == "N":
                pass
            else:
                out.append("J" if at(i + 1) in ("I", "E", "Y") else "K")
        elif c == "H":
            if at(i + 1) in ("A", "E", "I", "O", "U") and at(i - 1) not in ("C", "S", "P", "T", "G"):
                out.append("H")
        elif c == "P":
            if at(i + 1) == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "S":
            if at(i + 1) == "H":
                out.append("X")
                i += 1
            else:
                out.append("X" if w[i : i + 3] in ("SIO", "SIA") else "S")
        elif c == "T":
            if at(i + 1) == "H":
                out.append("0")
                i += 1
            else:
                out.append("X" if w[i : i + 3] in ("TIA", "TIO") else "T")
        elif c in "WY":
            if at(i + 1) in ("A", "E", "I", "O", "U"):
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "K":
            if at(i - 1) != "C":
                out.append("K")
        else:
            out.append({"Q": "K", "V": "F", "Z": "S"}.get(c, c))
        i += 1
    return "".join(out)


def metaphone(c: Column) -> Column:
    """[F14]"""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else metaphone_of(x))

    return F.pandas_udf(run, "string")(c)


def nfkd(c: Column) -> Column:
    """Without accents: decomposed (NFKD), combining marks dropped; for any script."""
    import unicodedata

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))

    return F.pandas_udf(run, "string")(c)


def code_similarity(x: Column, y: Column) -> Column:
    """0 to 100 from the edit distance of two codes; 0 if one is empty."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))


def with_phonetic_score(df: DataFrame, a: str, b: str, language: Column, out: str = "score") -> DataFrame:
    """Adds ``out``, 0 to 100: the better of metaphone and soundex similarity of two names.

    English names are coded as they are written, others without accents.  A
    name without a code scores 0; null names give null.
    """
    columns = df.columns
    for side, c in (("__a", a), ("__b", b)):
        df = df.withColumn(f"{side}n", nfkd(F.col(c))).withColumn(side, F.when(language == "en", F.col(c)).otherwise(F.col(f"{side}n"))).withColumn(f"{side}m", metaphone(F.col(side)))
    # soundex leaves a word that begins with no plain letter as it is
    code = lambda n: F.when(F.col(f"{n}n").rlike("^[A-Za-z]"), F.soundex(f"{n}n")).otherwise(F.lit(""))
    score = F.greatest(code_similarity(F.col("__am"), F.col("__bm")), code_similarity(code("__a"), code("__b")))
    return df.withColumn(out, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), score)).select(*columns, out)
