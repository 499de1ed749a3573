"""Scalar fixtures and decisions on a small synthetic master."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.rules import INSTITUTIONS
from tessera.plans import cascade as C
from tessera.sources import tables as T

NORMAL = {
    "P.E.S. College": "pes college", "K S R College": "ksr college", "K.J.Somaiya": "k j somaiya", "A B C D E F G H": "abcdef gh", "Dr. A.P.J.Abdul Kalam": "dr a p j abdul kalam", "Dr A P J Abdul": "dr apj abdul",
    "People's College": "peoples college", "Teachers' College": "teachers college", "Ross's Inst": "ross inst", "TechnologicalUniversity of X": "technological university of x", "Montréal": "montr al", "Montréal": "montr al", None: "",
}


def test_normalize(spark):
    rows = spark.createDataFrame([(k, v) for k, v in NORMAL.items()], "raw string, want string")
    assert [(r.raw, r.got) for r in rows.withColumn("got", X.normalize(F.col("raw"))).collect() if r.got != r.want] == []


def test_acronyms(spark):
    r = spark.createDataFrame([("lakshmi narain medical college and research centre",)], "c string").select(X.derived_acronyms(F.col("c")).alias("a")).first()
    assert sorted(r.a) == ["ln", "lnm", "lnmc", "lnmcr", "lnmcrc"]


MASTER = [
    (1, "Alpha Valley College", "Pune", "MH", "AVC", ""), (2, "Beta Hills College", "Pune", "MH", "", ""), (3, "Beta Hills College", "Indore", "MP", "", ""), (4, "Gamma Institute of Technology", "Bhopal", "MP", "", ""),
    (5, "Indian Institute of Technology", "Hyderabad", "TS", "IIT Hyderabad", ""), (6, "Jadavpur University", "Kolkata", "WB", "", ""),
]
CASES = [
    ("Alpha Valley College", "", "FOUND", 1, 100.0), ("College Alpha Valley", "", "FOUND", 1, 100.0), ("Beta Hills College", "Indore", "FOUND", 3, 100.0), ("Gamma Institute of Technology", "Jaipur", "NEEDS_REVIEW", 4, 70.0),
    ("IIT", "Hyderabad", "FOUND", 5, 99.0), ("", "", "NOT_FOUND", None, 0.0), ("!!!", "", "NOT_FOUND", None, 0.0), ("Zzyzx Qwerty", "", "NOT_FOUND", None, 0.0),
]


@pytest.fixture(scope="module")
def decided(spark):
    master = spark.createDataFrame(MASTER, "master_id long, name string, city string, state string, short_form string, category string")
    target = spark.createDataFrame([(i, n, c) for i, (n, c, *_) in enumerate(CASES)], "id long, name string, city string")
    _, out = C.match_all(master, target, "name", "city", row_id="id", rules=INSTITUTIONS)
    return {(r.input_name, r.input_city): r for r in out.collect()}


@pytest.mark.parametrize("case", CASES[:6] + CASES[7:])
def test_decisions(decided, case):
    r = decided[case[:2]]
    assert (r.decision, r.master_id, r.confidence) == case[2:]


def test_workbook():
    data = T.workbook_bytes([["Name", "Confidence Score"], ["a & b", 1.5], [None, 2.0]], numeric={1})
    rows, name = T.parse_workbook(data)
    assert name == "Sheet1" and rows[1] == ["a & b", "1.5"] and rows[2] == [None, "2.0"]
