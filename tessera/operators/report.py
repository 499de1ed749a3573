"""What is made of decisions: write-back, row decisions, audit, counts, review queue. Decisions have one row per match_key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed

STATUS = {"NOT_FOUND": "NOT FOUND", "NEEDS_REVIEW": "NEEDS REVIEW"}


def display_status(decision: Column) -> Column:
    """Words for a sheet; anything but the two known refusals counts as found."""
    out = F.lit("FOUND")
    for k, v in STATUS.items():
        out = F.when(decision == k, v).otherwise(out)
    return out


def row_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each row's decision; NOT_FOUND where there is none."""
    return rows.join(decisions.select("match_key", "decision"), "match_key", "left").withColumn("decision", F.coalesce("decision", F.lit("NOT_FOUND")))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


def confidence_buckets(decisions: DataFrame) -> DataFrame:
    """How many are at 95 or more, from 80 to below 95, below 80."""
    c = F.col("confidence")
    return decisions.agg(F.count_if(c >= 95).alias("high"), F.count_if((c >= 80) & (c < 95)).alias("medium"), F.count_if(c < 80).alias("low"))


def row_audit(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with a decision: input columns and all of the decision, in the order of _row_id where the rows have one."""
    d = decisions.select("match_key", "decision", F.coalesce(F.col("master_id").cast("string"), F.lit("Not Found")).alias("master_id"), F.coalesce("matched_name", F.lit("")).alias("matched_name"), "confidence", "reason")
    out = rows.join(d, "match_key")
    return out.orderBy("_row_id") if "_row_id" in rows.columns else out


def write_back(rows: DataFrame, decisions: DataFrame, id_column: str, status: str = "Match Status", confidence: str = "Confidence Score", name_column: str | None = None) -> DataFrame:
    """The target with its id column filled and two columns after it; rows without a decision keep what they had. The order of rows is that of _row_id
    where the rows have one. A name or id column that is missing, or both the same, is an error."""
    if id_column == name_column:
        raise ValueError("The name column and the id column must differ")
    missing = [c for c in (name_column, id_column) if c is not None and c not in rows.columns]
    if missing:
        raise ValueError(f"Target is missing columns: {missing}")
    had = [c for c in rows.columns if c != "match_key"]
    d = decisions.select("match_key", F.col("decision").alias("_decision"), F.col("master_id").alias("_id"), F.col("confidence").alias("_confidence"))
    j = rows.join(d, "match_key", "left")
    known = F.col("_decision").isNotNull()
    old = lambda c, kind: F.col(c).cast(kind) if c in had else F.lit(None).cast(kind)
    new = {
        id_column: F.when(known, F.coalesce(F.col("_id").cast("string"), F.lit("Not Found"))).otherwise(old(id_column, "string")),
        status: F.when(known, display_status(F.col("_decision"))).otherwise(old(status, "string")),
        confidence: F.when(known, F.coalesce("_confidence", F.lit(0.0))).otherwise(old(confidence, "double")),
    }
    order = [*had]
    for name, after in ((status, id_column), (confidence, status)):
        if name not in order:
            order.insert(order.index(after) + 1, name)
    if "_row_id" in had:
        j = j.orderBy("_row_id")
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in order])


def review_queue(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision = 'NEEDS_REVIEW'").select(F.col("input_name").alias("Input Name"), F.col("master_id").alias("Suggested ID"), F.col("matched_name").alias("Suggested Name"), F.col("confidence").alias("Confidence"), F.col("reason").alias("Reason"))


def label(c: DataFrame) -> Column:
    """id | name | city, state | confidence of a candidate row."""
    return F.concat(F.format_string("%d | %s | %s, %s | Confidence: ", "master_id", "name", "city", "state"), fixed(F.col("confidence"), 1))


def safe_ratio(done: Column, total: Column) -> Column:
    """done / total within 0 and 1; 0 where total is not positive."""
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total)))


def current(results: DataFrame, version: str) -> DataFrame:
    """Stored results of this engine version only."""
    return results.where(F.col("engine_version") == version)


def apply_reviews(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewers' overrides (match_key, master_id; null: not found) replace decisions that wait for review."""
    r = reviews.select("match_key", F.col("master_id").alias("_id"), F.lit(True).alias("_seen"))
    j = decisions.join(r, "match_key", "left").withColumn("_use", F.coalesce("_seen", F.lit(False)) & (F.col("decision") == "NEEDS_REVIEW"))
    return j.withColumns({"decision": F.when(F.col("_use"), F.when(F.col("_id").isNull(), "NOT_FOUND").otherwise("FOUND")).otherwise(F.col("decision")), "master_id": F.when(F.col("_use"), F.col("_id")).otherwise(F.col("master_id"))}).drop("_id", "_seen", "_use")
