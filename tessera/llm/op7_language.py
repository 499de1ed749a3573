"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector is the product of its letters' vectors, each permuted (rotated) by its place. A
document's vector is the sum over its n-grams, a language's prototype the sum over its training documents, each scaled to length one, less the mean of
all prototypes. A document is compared with each prototype by cosine. Since bundling is linear, the inner product with a prototype is a sum over
the document's n-grams of one number for each n-gram and language, computed once from the vectors; documents' vectors are never built.

A null text, or one without a letter, is `und` with score zero. Null languages teach nothing. Repeated rows count as often as they appear. With no
training row every document is `und`. A null doc_id is kept; its training part is decided as for any other (crc32 of null is null: not held out).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship, slices, table, texts_of, without

DIMENSIONS, N, ALPHABET, SEED = 2048, 3, 64, 11
UNKNOWN = "und"


@cache
def letter_classes() -> np.ndarray:
    """0 for what is no letter, 1 to 26 for a to z, 27 to 63 for other letters, spread by their lower-case code point."""
    from .pieces import LETTER, classes

    out = np.zeros(0x110000, np.uint8)
    points = np.flatnonzero(classes() == LETTER)
    low = np.array([ord(chr(c).lower()[0]) for c in points.tolist()], np.uint32)
    out[points] = np.where((low >= 97) & (low <= 122), low - 96, 27 + low * np.uint32(2654435761) % np.uint32(ALPHABET - 27))
    return out


def ngrams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of all texts; runs of non-letters are one blank; a text has a blank before and after it."""
    cp = np.frombuffer(("\n".join(["", *texts, ""])).encode("utf-32-le"), "<u4")
    letter = letter_classes()[cp]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = np.cumsum(size) - size + 1
    keep = (letter > 0) | np.append(True, letter[:-1] > 0)
    keep[at - 1] = True
    sym, where = letter[keep].astype(np.int64), np.flatnonzero(keep)
    if len(sym) < n:
        return (np.empty(0, np.int64),) * 3
    code = np.zeros(len(sym) - n + 1, np.int64)
    for j in range(n):
        code = code * ALPHABET + sym[j : j + len(code)]
    doc = np.searchsorted(at, where[n // 2 : n // 2 + len(code)], "right") - 1
    ok = (doc >= 0) & (code % ALPHABET + code // ALPHABET > 0) & ~((sym[n // 2 : n // 2 + len(code)] == 0))
    key, count = np.unique(doc[ok] * ALPHABET**n + code[ok], return_counts=True)
    return key // ALPHABET**n, key % ALPHABET**n, count


def gram_vectors(codes: np.ndarray, n: int = N, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (ALPHABET, dimensions))
    out = np.ones((len(codes), dimensions), np.int8)
    for j in range(n):
        out *= np.roll(letters, j, axis=1)[codes // ALPHABET ** (n - 1 - j) % ALPHABET]
    return out


def learn(docs: DataFrame, n: int = N, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, n-grams and the score of each n-gram for each language. It learns from all rows of text and lang; only sums over
    languages and n-grams (at most ALPHABET**n for each language) reach the driver."""
    ship(docs.sparkSession)
    kinds = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("weight", pa.float64())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = texts_of(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
            for a, b in slices(texts):
                doc, code, count = ngrams(texts[a:b], n)
                length = np.sqrt(np.bincount(doc, count.astype(float) ** 2, b - a))
                for lang in set(langs[a:b].tolist()):
                    own = langs[a:b][doc] == lang
                    if lang not in total:
                        total[lang] = np.zeros(ALPHABET**n)
                    np.add.at(total[lang], code[own], count[own] / length[doc[own]])
        for lang, sums in total.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(sums[some])], schema=kinds)

    sums = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, gram long, weight double")
    got = sums.groupBy("lang", "gram").agg(F.sum("weight").alias("weight")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    codes = np.unique(got["gram"].to_numpy())
    weight = np.zeros((len(langs), len(codes)))
    weight[[langs.index(x) for x in got["lang"]], np.searchsorted(codes, got["gram"])] = got["weight"]
    weight /= np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-30)
    prototypes = np.zeros((len(langs), dimensions))
    for a in range(0, len(codes), 4096):
        prototypes += weight[:, a : a + 4096] @ gram_vectors(codes[a : a + 4096], n, dimensions)
    if len(langs) > 1:
        prototypes -= prototypes.mean(0)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-30)
    return langs, codes, np.concatenate([gram_vectors(codes[a : a + 4096], n, dimensions) @ prototypes.T for a in range(0, len(codes), 4096)] or [np.zeros((0, len(langs)))])


def classify(texts: list[str | None], model, n: int = N, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The language of each text and how far the best cosine leads, from 0 to 1."""
    langs, codes, scores = model
    filled = [t or "" for t in texts]
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs:
        return pred, score
    for a, b in slices(filled):
        doc, code, count = ngrams(filled[a:b], n)
        cos = np.zeros((b - a, len(langs)))
        at = np.searchsorted(codes, code)
        at[at == len(codes)] = 0
        known = codes[at] == code if len(code) else np.empty(0, bool)
        for k in range(len(langs)):
            cos[:, k] = np.bincount(doc[known], count[known] * scores[at[known], k], b - a)
        # vectors of n-grams are nearly orthogonal: a document's squared length is dimensions times its sum of squared counts
        cos /= np.maximum(np.sqrt(dimensions * np.bincount(doc, count.astype(float) ** 2, b - a)), 1e-30)[:, None]
        best = cos.argmax(1)
        spread = np.exp(16 * (cos - cos.max(1, keepdims=True)))
        sure = 1 / spread.sum(1)
        some = np.bincount(doc, minlength=b - a) > 0
        for i in np.flatnonzero(some).tolist():
            pred[a + i] = langs[best[i]]
        score[a:b] = np.where(some, sure, 0.0)
    return pred, score


def predict(docs: DataFrame, model) -> DataFrame:
    """All columns, with lang_pred and score (which replace input columns of these names)."""
    ship(docs.sparkSession)
    docs = without(docs, ("lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ALPHABET**N n-grams
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            pred, score = classify(batch.column(place).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select("lang", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
