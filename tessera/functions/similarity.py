"""String similarities as Columns: cosine, Jaccard and Sorensen-Dice of tokens, normalised Levenshtein, Jaro-Winkler."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("cosine", "jaccard", "sorensen_dice", "normalized_levenshtein", "jaro_winkler")
SPLIT = r"[\W_]"


def tokens(c: Column) -> Column:
    """Lower-case tokens with repeats."""
    return F.array_remove(F.split(F.lower(c.cast("string")), SPLIT), "")


def _count(a: Column, t: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == t)).cast("double")


def cosine(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, t: s + _count(x, t) * _count(y, t))
    norm = lambda z: F.sqrt(F.aggregate(F.array_distinct(z), F.lit(0.0), lambda s, t: s + _count(z, t) * _count(z, t)))
    d = norm(x) * norm(y)
    return F.when(d > 0, dot / d).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def sorensen_dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    n = F.size(x) + F.size(y)
    return F.when(n > 0, 2 * F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    a, b = a.cast("string"), b.cast("string")
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n).otherwise(1.0)


def jaro_winkler_pair(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else jaro_winkler_pair(u, v) for u, v in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(batch, "double")(a.cast("string"), b.cast("string"))


def similarity(name: str, a: Column, b: Column) -> Column:
    """0 where either side is null."""
    if name not in NAMES:
        raise ValueError(f"unknown similarity {name!r}")
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(globals()[name](a, b))
