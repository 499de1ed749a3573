"""Location phrases: the dictionary, detection in texts by an equi-join on word n-grams, and removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical, tokens
from .rules import INSTITUTIONS, RuleSet

#: Rows up to which a side of a join is broadcast; beyond that Spark chooses.
BROADCAST_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Written once as a table in the shared folder of spark.checkpoint.dir and read again: later plans start from its rows and know its size. A local
    folder stands in only where the session names none and runs on one machine. (checkpoint() would compute its rows twice.)"""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_tessera_cuts", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = sc._tessera_cuts = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    path = f"{folder.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def phrase_dictionary(locations: DataFrame, rules: RuleSet = INSTITUTIONS) -> DataFrame:
    """phrase, canonical, n_words from rows of (raw, clean) locations and the alias names."""
    spark = locations.sparkSession
    own = locations.select(F.explode(F.array("raw", "clean")).alias("phrase"))
    if rules.aliases:
        own = own.union(spark.createDataFrame([(a,) for a in rules.aliases], "phrase string"))
    own = own.where("phrase <> ''").distinct()
    return own.select("phrase", canonical(F.col("phrase"), rules).alias("canonical"), F.size(tokens(F.col("phrase"))).alias("n_words"))


def measure(phrases: DataFrame) -> tuple[int, int]:
    """Words of the longest phrase, and how many phrases there are."""
    return tuple(phrases.agg(F.coalesce(F.max("n_words"), F.lit(0)), F.count("*")).first())


def detect(texts: DataFrame, phrases: DataFrame, rules: RuleSet = INSTITUTIONS, size: tuple[int, int] | None = None) -> DataFrame:
    """text, location and phrase of each distinct normalized text with a phrase: the one that starts last, then the longest (or the other way round).
    `size` is what measure() said of the phrases, if known."""
    longest, n = size or measure(phrases)
    if not longest:
        return texts.select("text").limit(0).select("text", F.lit("").alias("location"), F.lit("").alias("phrase"))
    words = texts.select("text").where("text <> ''").distinct().select("text", tokens(F.col("text")).alias("w"))
    grams = words.select("text", F.posexplode("w").alias("pos", "_w"), "w").select("text", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("pos")))).alias("k"), "w")
    grams = grams.select("text", "pos", F.array_join(F.slice("w", F.col("pos") + 1, F.col("k")), " ").alias("phrase"))
    hit = grams.join(F.broadcast(phrases) if n <= BROADCAST_ROWS else phrases, "phrase")
    order = F.struct(F.length("phrase"), "pos") if rules.longest_location else F.struct("pos", F.length("phrase"))
    return hit.groupBy("text").agg(F.max_by(F.struct("canonical", "phrase"), order).alias("best")).select("text", F.col("best.canonical").alias("location"), F.col("best.phrase").alias("phrase"))


def without_phrase(text: Column, phrase: Column) -> Column:
    """The text without the words of the phrase, wherever it stands."""
    padded = F.replace(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")), F.lit(" "))
    return F.when(phrase == "", text).otherwise(F.trim(F.regexp_replace(padded, " +", " ")))


def with_location(df: DataFrame, text: str, phrases: DataFrame, rules: RuleSet, location: str, phrase: str | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Adds the detected location (and phrase) of a text column; '' where there is none."""
    found = detect(df.select(F.col(text).alias("text")), phrases, rules, size).select(F.col("text").alias(text), F.col("location").alias(location), F.col("phrase").alias(phrase or "_phrase"))
    out = df.join(found, text, "left").withColumn(location, F.coalesce(location, F.lit("")))
    return out.withColumn(phrase, F.coalesce(phrase, F.lit(""))) if phrase else out.drop("_phrase")
