"""Ratios against plain versions and values published for them."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z


def indel(a, b):
    """By the whole table of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row, was = [0], row
        for j, y in enumerate(b):
            row.append(was[j] + 1 if x == y else max(was[j + 1], row[j]))
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_published_values():
    assert Z.indel_ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert Z.partial_ratio("this is a test", "this is a test!") == 100
    assert Z.indel_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(90.91, abs=0.01)
    assert Z.SCORERS["composite"][2]("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert Z.set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert Z.set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat") == pytest.approx(92.31, abs=0.01)


def test_ratios_brute():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    for _ in range(300):
        a, b = (" ".join(word() for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert Z.indel_ratio(a, b) == pytest.approx(indel(a, b))
        assert Z.difflib_ratio(a, b) == 100 * SequenceMatcher(None, a, b).ratio()
        short, long = sorted((a, b), key=len)
        if short:
            windows = [long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))]
            assert Z.partial_ratio(a, b) == pytest.approx(max(indel(short, w) for w in windows))
        x, y = set(a.split()), set(b.split())
        if x and y:
            join = lambda *sets: " ".join(w for s in sets for w in sorted(s))
            want = 100.0 if x & y and (x <= y or y <= x) else max([indel(join(x & y, x - y), join(x & y, y - x))] + ([indel(join(x & y), join(x & y, s)) for s in (x - y, y - x)] if x & y else []))
            assert Z.set_ratio(a, b) == pytest.approx(want)
        c = Z.composite_ratio(a, b)
        assert 0 <= c <= 100 and (not a or Z.composite_ratio(a, a) == 100) and c == pytest.approx(Z.composite_ratio(b, a))


def test_lexical_score_takes_the_best(spark):
    df = spark.createDataFrame([("alpha beta pune", "alpha beta", ["beta alpha", "", "gamma"])], "w string, b string, v array<string>")
    for scorer in Z.SCORERS:
        assert df.select(Z.lexical_score(F.col("w"), F.col("b"), F.col("v"), scorer)).first()[0] == 100.0
