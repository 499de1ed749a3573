"""The corpus pipeline: quality, language, near-duplicates, PII, packing. Each stage works on what the stage before it kept.

All stages but the last return the columns of documents. Rows with nulls, empty texts and repeated rows are treated as the operators' docstrings
say; a document whose language is `und` is rejected, and so is one whose language is not among those learned well enough (see LANGUAGE_SCORE).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm import op3_packing as packing
from tessera.llm import op4_pii as pii
from tessera.llm import op7_language as language
from tessera.llm import op9_quality as quality
from tessera.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language must lead by so much; real texts of any length do.
LANGUAGE_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are likelier good than not."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where(F.col("quality_score") >= quality.KEEP).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; profiles are learned from the documents of this stage."""
    model = language.learn(docs.where(~language.held_out()).select("lang", "text"))
    return language.predict(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word similarity 0.8 or more: the one with the smallest doc_id (one row of it, if it repeats). Rows without a doc_id are kept.
    SimHash (op10) and bands choose the candidates, shingles decide them (see tessera/llm/near.py).

    The ids kept grow with the corpus, so they are joined by a shuffle at every size.
    """
    groups = near.near_duplicate_groups(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = one_row_per_id(docs.join(first.hint("shuffle_hash"), "doc_id", "left_semi")).select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Of rows that share a doc_id, the one with the least hash of its other columns."""
    several = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if several.isEmpty():
        return docs
    others = docs.join(several, "doc_id", "left_anti")
    least = docs.join(several, "doc_id", "left_semi").withColumn("h", F.xxhash64(*COLUMNS)).groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), "h").alias("row"))
    return others.select(*COLUMNS).unionByName(least.select("row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the text."""
    out = pii.with_surrogates(docs.select(*COLUMNS), pii.session_key(spark))
    changed = F.size("entity_kinds") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return packing.pack(packing.document_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: Trained models, iterated components and tokenization are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
