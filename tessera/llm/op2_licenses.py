"""License scans by diagonal voting.

Every document's rolling word k-gram hashes are joined with the positions of the same hashes in license templates; matches are counted by document,
template and offset diagonal; neighbouring diagonals (words inserted or left out) are merged; a merged group with enough votes is a span, which is
verified on the words themselves by their longest common subsequence with the template. Base phrases are counted in the same pass over the text.

Null and empty texts have no words: counts zero, first_word and last_word null, labels empty, score zero. Repeated rows give repeated results (their
votes count once); rows that share a doc_id but not a text stay apart; a null doc_id is kept. Only the columns doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, row_key, ship, slices, table, texts_of
from .words import WORD_BYTES, grams, hashes, joined, runs

K, GAP, SIMILARITY = 4, 3, 0.8
#: Templates may hold so many words together that their join table stays small enough to broadcast.
TEMPLATE_WORDS = 100_000

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, notice): what license notices say, as published with the licenses.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Licensed under CC BY NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def word_list(text: str) -> list[bytes]:
    data, _ = joined([text])
    return [data[a:b].tobytes() for a, b in zip(*runs(WORD_BYTES[data]))]


def word_hashes(text: str) -> np.ndarray:
    data, _ = joined([text])
    return hashes(data, *runs(WORD_BYTES[data]))


def template_positions(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """h, template, position of every k-gram of the templates."""
    rows = [(int(h), t, p) for t, (_, text) in enumerate(templates) for p, h in enumerate(grams(word_hashes(text), k).view(np.int64))]
    if len(rows) > TEMPLATE_WORDS:
        raise ValueError("too many template words for a broadcast")
    return spark.createDataFrame(rows, "h long, template int, position int")


def least_votes(n: int, k: int = K, similarity: float = SIMILARITY) -> int:
    """The k-grams of a template of n words that survive any changes a verified span may have, but at least one."""
    return max(1, n - k + 1 - k * int(round((1 - similarity) * n, 9)))


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    code: dict[bytes, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in a])
    y = [code.get(w, -1) for w in b]
    row = np.zeros(len(a) + 1, np.int64)
    for w in y:
        best = np.append(0, np.where(x == w, row[:-1] + 1, 0))
        row = np.maximum.accumulate(np.maximum(row, best))
    return int(row[-1])


def template_grams(source: DataFrame, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """doc_id, rk, p, h of the k-grams of (doc_id, rk, text) that some template has too; the others can't vote and stay in the worker."""
    own = [grams(word_hashes(text), k) for _, text in templates]
    wanted = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]))
    kinds = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("p", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in slices(texts):
                data, at = joined(texts[a:b])
                start, stop = runs(WORD_BYTES[data])
                g = grams(hashes(data, start, stop), k)
                if not len(g) or not len(wanted):
                    continue
                doc = np.searchsorted(at, start, "right") - 1
                first_of = np.searchsorted(doc, np.arange(b - a + 1))
                at_template = wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g
                w = np.flatnonzero(at_template & (doc[: len(g)] == doc[k - 1 :]))
                rows = pa.array(a + doc[w])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((w - first_of[doc[w]]).astype(np.int32)), pa.array(g[w].view(np.int64))], schema=kinds)

    return source.select("doc_id", "rk", "text").mapInArrow(run, "doc_id long, rk long, p int, h long")


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """The base columns of each row; and the verified spans (rk, doc_id, label, first, last, similarity)."""
    spark = docs.sparkSession
    ship(spark)
    known = [(label, word_hashes(p)) for p, label in phrases.items()]
    kinds = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string())])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in slices(texts):
                data, at = joined(texts[a:b])
                start, stop = runs(WORD_BYTES[data])
                h = hashes(data, start, stop)
                n = b - a
                doc = np.searchsorted(at, start, "right") - 1
                first_of = np.searchsorted(doc, np.arange(n + 1))
                found: list[dict[str, list[int]]] = [{} for _ in range(n)]
                for label, p in known:
                    m = len(p)
                    if len(h) < m:
                        continue
                    ok = h[: len(h) - m + 1] == p[0]
                    for j in range(1, m):
                        ok &= h[j : len(h) - m + 1 + j] == p[j]
                    w = np.flatnonzero(ok)
                    for w in w[doc[w] == doc[w + m - 1]].tolist():
                        found[doc[w]].setdefault(label, []).append(w - int(first_of[doc[w]]))
                counts = np.diff(first_of)
                every = [sorted(x for v in f.values() for x in v) for f in found]
                out = [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(counts), pa.array([len(x) for x in every], pa.int64()), pa.array([x[0] if x else None for x in every], pa.int64()), pa.array([x[-1] if x else None for x in every], pa.int64()), pa.array([",".join(sorted(f)) for f in found])]
                yield pa.RecordBatch.from_arrays(out, schema=kinds)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").withColumn("rk", row_key("doc_id", "text"))
    base = source.select("doc_id", "rk", "text").mapInArrow(run, "doc_id long, rk long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    places = template_positions(spark, templates, k)
    # equal rows share rk: a place votes once
    votes = template_grams(source, templates, k).join(F.broadcast(places), "h").dropDuplicates(["doc_id", "rk", "template", "position", "p"])
    diagonals = votes.groupBy("doc_id", "rk", "template", (F.col("p") - F.col("position")).cast("long").alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"), F.min("position").alias("t_low")
    )
    by = W.partitionBy("doc_id", "rk", "template").orderBy("diagonal")
    near = diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 40)).over(by) > gap).cast("int"))
    near = near.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "rk", "template", "run").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    sizes = [len(word_list(text)) for _, text in templates]
    least = F.array(*[F.lit(least_votes(n, k)) for n in sizes])
    spans = near.where(F.col("votes") >= F.element_at(least, F.col("template") + 1))
    spans = cut(spans.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans")))
    texts_kinds = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("similarity", pa.float64())])

    def verify(batches):
        words = [word_list(text) for _, text in templates]
        for batch in batches:
            rows = []
            for doc, rk, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                got = word_list(text or "")
                for s in own:
                    t = words[s["template"]]
                    # a template may reach beyond its first and last matching k-gram
                    lo, hi = max(0, s["low"] - len(t)), min(len(got), s["high"] + k + len(t))
                    for c in range(lo, hi, 4 * len(t)):  # long groups in overlapping stretches
                        c_hi = min(hi, c + 8 * len(t))
                        share = common_words(t, got[c:c_hi]) / len(t)
                        if share >= SIMILARITY and tight(t, got[c:c_hi]):
                            rows.append((doc, rk, templates[s["template"]][0], max(lo, s["low"]), s["high"] + k - 1, share))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, texts_kinds)], schema=texts_kinds)

    def tight(t, got):
        """Some stretch of at most the template's length over the similarity holds the common words."""
        width = int(len(t) / SIMILARITY) + 1
        return any(common_words(t, got[i : i + width]) >= SIMILARITY * len(t) for i in range(0, max(1, len(got) - width + 1)))

    spans = spans.withColumnRenamed("doc_id", "span_doc")
    with_text = source.join(spans.hint("shuffle_hash") if spans.count() > 100_000 else F.broadcast(spans), ["rk"]).where(F.col("doc_id").eqNullSafe(F.col("span_doc")))
    verified = with_text.select("doc_id", "rk", "text", "spans").mapInArrow(verify, "doc_id long, rk long, label string, first long, last long, similarity double")
    return base, verified


def license_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: counts, base labels, all labels, and a score of 1 for a base phrase, else the best verified similarity."""
    base, verified = scan_licenses(docs, **how)
    per = cut(verified.groupBy("rk", F.col("doc_id").alias("span_doc")).agg(F.collect_set("label").alias("more"), F.max("similarity").alias("similarity")))
    out = base.join(per.hint("shuffle_hash") if per.count() > 100_000 else F.broadcast(per), (base["rk"] == per["rk"]) & base["doc_id"].eqNullSafe(per["span_doc"]), "left")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))
