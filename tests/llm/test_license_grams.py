"""Only k-grams that some template has leave the workers of the license scan."""

import random

from tessera.llm import op2_licenses as op2


def test_only_template_grams_leave_the_workers(spark):
    rng = random.Random(6)
    words = "permission is hereby granted free of charge to any person x1 été".split()
    texts = [None, "", "one two", "no such words in here " * 300, "Released under the MIT License"] + [" ".join(rng.choice(words[: 2 + i % 11]) for _ in range(40)) + " Permission is hereby granted, free of charge" for i in range(30)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rk long").repartition(2)
    known = {tuple(w[i : i + 4]) for _, t in op2.TEMPLATES for w in [op2.word_list(t)] for i in range(len(w) - 3)}
    want = [(i, p) for i, t in enumerate(texts) for w in [op2.word_list(t or "")] for p in range(len(w) - 3) if tuple(w[p : p + 4]) in known]
    got = op2.template_grams(docs, op2.TEMPLATES, 4).collect()
    assert sorted((r.doc_id, r.p) for r in got) == want and all(r.rk == r.doc_id for r in got) and 3 not in {r.doc_id for r in got}
    assert op2.template_grams(docs, [], 4).count() == 0
    base, _ = op2.scan_licenses(docs)
    assert base.columns == ["doc_id", "rk", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    # the plan of the report passes no list of hashes from Python to the JVM
    assert "array<bigint>" not in op2.license_report(docs)._jdf.queryExecution().analyzed().schema().simpleString() and "grams" not in op2.license_report(docs)._jdf.queryExecution().analyzed().toString()
