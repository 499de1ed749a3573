"""Each operator and each pipeline stage with nulls in any column, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import op1_additive, op2_licenses, op3_packing, op4_pii, op5_crosspolytope, op6_secrets, op7_language, op8_bpe, op9_quality, op10_simhash

DIR = "/root/testdata/sf0.001"
#: Extra columns are named like what the operators add.
CLASH = ["score", "lang_pred", "entity_kinds", "quality_score", "text_score", "Meta_Score", "fp", "node", "rk", "piece", "length", "labels", "spans", "h", "key", "label"]


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def licenses(docs):
    return op2_licenses.license_report(docs)


def packing(docs):
    return op3_packing.pack(op3_packing.document_pieces(docs, path("byte_bpe_50k.json")))


def surrogates(docs):
    return op4_pii.with_surrogates(docs, b"key")


def secrets(docs):
    return op6_secrets.report(docs, op6_secrets.infer(docs))


def language(docs):
    return op7_language.predict(docs, op7_language.learn(docs.select("lang", "text")))


def bpe(docs):
    return op8_bpe.bpe_round_trip(docs, path("byte_bpe_multi_50k.tiktoken"))


def quality(docs):
    labels = docs.sparkSession.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(None, 1, 0), (3, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    return op9_quality.score_documents(docs, op9_quality.fit(docs, labels))


def simhash(docs):
    return op10_simhash.simhash_components(docs)


OPERATORS = [licenses, packing, surrogates, secrets, language, bpe, quality, simhash]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(1, 9)))
    texts = [None, "", "  \n ", "\U0001f600" * 50, "x" * 300_000, " ".join(word() for _ in range(60_000)), "token = abcdefgh1234 Mr. Karl Meyer a@b.example.org", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]
    texts += [" ".join(word() for _ in range(30)) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if i % 7 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += rows[:12] + [(None, "lost", None, None, None), (None, None, None, None, None), (5, "another text of the same id", "en", "a", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=str)


@pytest.mark.parametrize("op", OPERATORS, ids=lambda f: f.__name__)
def test_operator(spark, odd, op):
    out = op(odd)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if op is packing:
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    else:
        assert sorted((r.doc_id for r in rows), key=str) == ids(odd)
    # extra columns change nothing, whatever their names
    more = op(clashing(odd))
    shared = [c for c in out.columns if c not in ("sequence_id", "offset")]
    assert len({c.lower() for c in more.columns}) == len(more.columns)
    assert sorted(map(repr, more.select(*shared).collect())) == sorted(map(repr, out.select(*shared).collect()))
    assert op(odd.limit(0)).count() == 0
    assert op(odd.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema])).count() == odd.count()


@pytest.mark.parametrize("op", [licenses, surrogates, secrets, language, bpe, simhash], ids=lambda f: f.__name__)
def test_repeated_rows_repeat_results(spark, odd, op):
    """Three times the table: each row's result thrice, the same as once."""
    if op in (secrets, language):  # what they learn is given
        learned = (op6_secrets.infer if op is secrets else lambda d: op7_language.learn(d.select("lang", "text")))(odd)
        run = lambda d: (op6_secrets.report if op is secrets else op7_language.predict)(d, learned)
    else:
        run = op
    once, thrice = run(odd).collect(), run(odd.union(odd).union(odd)).collect()
    assert sorted(map(repr, thrice)) == sorted(map(repr, once * 3))


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.001]), (7, [1.0, 0.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("score", "node", "h", "rank", "query", "q", "b", "key", "weight", "root", "first")])
    found = {(r.query_id, r.vec_id) for r in op1_additive.search(op1_additive.build_index(df, books=2, words=2), df).collect()}
    assert found == {(1, 6), (6, 1)}
    linked = op5_crosspolytope.embedding_components(df).collect()
    assert len(linked) == len(rows) and {(r.vec_id, r.n_links, r.component_id) for r in linked if r.vec_id in (1, 6)} == {(1, 1, 1), (6, 1, 1)}
    assert op5_crosspolytope.embedding_components(df.limit(0)).count() == 0 and op1_additive.search(op1_additive.build_index(df.limit(0)), df).count() == 0


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("at", range(5))
def test_stage(spark, odd, at):
    import corpus_pipeline as cp

    name, stage = stages()[at]
    out = stage(spark, odd, DIR)
    got = out.collect()
    if at < 4:
        assert out.columns == cp.COLUMNS
        assert {r.doc_id for r in got} <= {r.doc_id for r in odd.collect()}
    if name == "pii":
        text = {r.doc_id: r.text for r in got}
        assert len(got) == odd.count() and "a@b.example.org" not in text[6] and "Meyer" not in text[6] and text[0] is None and text[1] == ""
        assert all(r.n_chars == len(r.text) for r in got if r.doc_id == 6)
    if name == "packing":
        assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    if name == "language":
        assert not {r.doc_id for r in got} & {0, 1, 2, 3}  # no letter: und
    if name == "near_duplicates":
        kept = [r.doc_id for r in got]
        assert len([i for i in kept if i is not None]) == len({i for i in kept if i is not None}) and {*range(4, 60)} - {*kept} <= {5}
    extra = stage(spark, clashing(odd), DIR)
    assert extra.columns == out.columns and extra.count() == len(got)
    assert stage(spark, odd.limit(0), DIR).count() == 0
    stage(spark, odd.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema]), DIR).count()


def test_stages_against_their_operators(spark):
    """Each decision of a stage is that of its operator."""
    import corpus_pipeline as cp

    docs = cp.table(spark, DIR, "documents").select(*cp.COLUMNS)
    labels = cp.table(spark, DIR, "labels")
    good = {r.doc_id for r in op9_quality.score_documents(docs, op9_quality.fit(docs, labels)).collect() if r.quality_score >= op9_quality.KEEP}
    assert {r.doc_id for r in cp.quality_stage(spark, docs, DIR).collect()} == good
    assert {r.doc_id for r in cp.language_stage(spark, docs, DIR).collect()} == {r.doc_id for r in op7_language.predict(docs, op7_language.learn(docs.where(~op7_language.held_out()).select("lang", "text"))).collect() if r.score >= cp.LANGUAGE_SCORE and r.lang_pred != "und"}
    for r in cp.pii_stage(spark, docs, DIR).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        assert r.text == op4_pii.replaced(r.was, op4_pii.OPEN_KEY, {})[0]
    packed = cp.packing_stage(spark, docs, DIR).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in packed) <= 1024
