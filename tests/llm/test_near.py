"""Near-duplicate stage against five-word Jaccard similarity by brute force."""

import random
import re

from tests.llm.test_ops import DIR


def groups(named):
    """The least doc_id of each document's group, all pairs compared."""
    made = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in named]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in made]
    label = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and label[i] != label[j] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_near_copies_of_short_texts(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    named, k = [], 0
    for n in (40, 50, 60, 90, 150, 400):
        for _ in range(6):
            words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
            for changes in (0, 1, 1, 2, n // 12):
                copy = list(words)
                for at in rng.sample(range(n), changes):
                    copy[at] = f"changed{rng.randint(0, 999)}"
                named.append((k, " ".join(copy)))
                k += 1
    named += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One, two!")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in named], spark.read.parquet(f"{DIR}/documents.parquet").select(*cp.COLUMNS).schema)
    label = groups(named)
    got = sorted(r.doc_id for r in cp.near_duplicate_stage(spark, docs, DIR).collect())
    assert got == sorted({*label.values()}) and len(got) < len(named) - 50


def test_near_duplicate_tables(spark):
    import corpus_pipeline as cp

    docs = cp.table(spark, DIR, "documents").select(*cp.COLUMNS)
    got = sorted(r.doc_id for r in cp.near_duplicate_stage(spark, docs, DIR).collect())
    assert got == sorted({*groups([(r.doc_id, r.text) for r in docs.collect()]).values()})
