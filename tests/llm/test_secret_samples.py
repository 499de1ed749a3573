"""The examples that the secret scan learns from: the lowest hashes of the whole corpus, merged without files of their own."""

import os
import random

import pytest
from xxhash import xxh64_intdigest

from tessera.llm import common, op6_secrets as op6


def by_hash(values, n):
    return [v for _, v in sorted((xxh64_intdigest(v) >> 1, v) for v in set(values))[:n]]


def corpus():
    """Texts with every kind of credential, some of them repeated; and their values by kind, found text by text."""
    rng = random.Random(11)
    some = lambda cs, n: "".join(rng.choice(cs) for _ in range(n))
    words = [some("abcxyzé", rng.randint(3, 14)) for _ in range(900)]
    texts = [None, "", "token: short", "é" * 40]
    for _ in range(300):
        texts.append(" ".join(rng.choice(words) for _ in range(9)) + rng.choice(["", f' token = "{some("ABCxyz019", 12)}" end', f" AKIA{some('ABC012', 17)} x", f" {some('0123456789abcdef', 30)} y"]))
    texts += texts[50:90] * 3
    values: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
    for t in filter(None, texts):
        base, _, _, a, b = op6.scan([t])
        for span in base[0]:
            values[span[1]].append(op6.value_of(t, span))
        values[3] += [t[x:y] for x, y in zip(a.tolist(), b.tolist())]
    return texts, values


@pytest.mark.parametrize("parts", [1, 40])
def test_samples_are_the_lowest_of_the_corpus(spark, parts):
    texts, values = corpus()
    most = {0: 20, 1: 7, 2: 1000, 3: 150}
    assert all(len(set(values[k])) > most[k] for k in (0, 1, 3)) and 0 < len(set(values[2])) < most[2]
    got = op6.samples(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts), most).collect()
    assert {k: [r.value for r in got if r.label == k] for k in most} == {k: by_hash(values[k], n) for k, n in most.items()}
    assert all(r.h == xxh64_intdigest(r.value) >> 1 for r in got)


def test_learning_writes_nothing_to_the_shared_folder(spark, monkeypatch):
    texts, values = corpus()
    seen = []
    monkeypatch.setattr(op6, "train", lambda credentials, ordinary: seen.append((credentials, ordinary)))
    there = common.shared_dir(spark).removeprefix("file://")
    before = {*os.listdir(there)}
    op6.infer(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), examples=20, ordinary=150)
    assert seen == [({k: by_hash(values[k], 20) for k in (0, 1, 2)}, by_hash(values[3], 150))]
    assert {*os.listdir(there)} == before


def test_samples_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert op6.samples(none, {0: 5, 1: 5, 2: 5, 3: 5}).collect() == [] and op6.infer(none) is None


def test_lowest_keeps_equal_hashes_apart():
    lowest = op6.Lowest({0: 2, 3: 1})
    for h, v in [(5, "e"), (1, "b"), (1, "a"), (9, "z")] * 3 + [(k, f"v{k}") for k in range(2, 40)]:
        lowest.add(0, h, v)
    assert lowest.rows(0) == [(0, 1, "a"), (0, 1, "b")] and lowest.rows(3) == [] and lowest.batch().num_rows == 2


def test_readers_hold_few_whole_texts(spark):
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    for op in (lambda d: op6.report(d, None), lambda d: op6.samples(d, {0: 1, 1: 1, 2: 1, 3: 1})):
        for own, want in ((None, common.READ_ROWS), (1000, 1000)):  # a session's own choice stays
            session = spark.newSession()
            if own:
                session.conf.set(rows, str(own))
            op(session.createDataFrame([(1, "a")], "doc_id long, text string"))
            assert session.conf.get(rows) == str(want)
    assert spark.newSession().conf.get(rows) == "4096"
