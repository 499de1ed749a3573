"""Fuzzy ratios as Arrow-batched UDFs; apply them to rows that native gates have already let through.

difflib: SequenceMatcher ratios (plain, sorted words, distinct sorted words). indel: the same with 200 * LCS / (n + m), the normalized insertion-deletion
similarity. composite: indel ratios weighted as the usual fuzzy-matching libraries publish it (see composite_ratio).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def difflib_ratio(a: str, b: str) -> float:
    return 100.0 * SequenceMatcher(None, a, b).ratio()


def indel_ratio(a: str, b: str) -> float:
    """One bit per character of `a`: the classic bit-parallel LCS."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def _distinct(text: str) -> str:
    return " ".join(sorted(set(text.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best indel ratio of the shorter text with any stretch of the longer that is as long, or shorter at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for k in range(1 - n, len(b)):
        best = max(best, indel_ratio(a, b[max(0, k) : k + n]))
        if best == 100.0:
            break
    return best


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words alone and with either side's other words; 100 if one side has no others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, mine, theirs = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not mine or not theirs):
        return 100.0
    shared = " ".join(sorted(both))
    with_mine, with_theirs = f"{shared} {mine}".strip(), f"{shared} {theirs}".strip()
    best = indel_ratio(with_mine, with_theirs)
    return max(best, indel_ratio(shared, with_mine), indel_ratio(shared, with_theirs)) if both else best


def composite_ratio(a: str, b: str) -> float:
    """The weighted best of whole, word-wise and partial ratios: word-wise ones count 0.95; where one text is 1.5 times as long as the other, partial ones
    take the place of whole ones and count 0.9 (0.6 from 8 times on)."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(indel_ratio(_sorted(a), _sorted(b)), set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * words)


#: For each scorer the ratio of whole texts, that of their distinct words and that of their words in order.
SCORERS = {
    "difflib": (difflib_ratio, lambda a, b: difflib_ratio(_distinct(a), _distinct(b)), lambda a, b: difflib_ratio(_sorted(a), _sorted(b))),
    "indel": (indel_ratio, lambda a, b: indel_ratio(_distinct(a), _distinct(b)), lambda a, b: indel_ratio(_sorted(a), _sorted(b))),
    "composite": (composite_ratio, set_ratio, lambda a, b: indel_ratio(_sorted(a), _sorted(b))),
}


def lexical_score(whole: Column, bare: Column, values: Column, scorer: str = "difflib") -> Column:
    """The best ratio of an input (whole, and without its location) with any of a record's comparison values."""
    plain, by_set, in_order = SCORERS[scorer]

    @F.pandas_udf("double")
    def run(w: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for x, y, vs in zip(w, b, v):
            best = 0.0
            for c in vs:
                if c:
                    best = max(best, plain(x, c), plain(y, c), by_set(y, c), in_order(y, c))
            out.append(best)
        return pd.Series(out, dtype="float64")

    return run(whole, bare, values)


def ratio(a: Column, b: Column, scorer: str = "difflib") -> Column:
    f = SCORERS[scorer][0]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)
