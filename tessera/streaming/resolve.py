"""An extension: exact resolution of a stream of names against a static index, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import locations as L
from ..operators.index import Index
from ..operators.rules import INSTITUTIONS, RuleSet


def resolve_stream(names: DataFrame, index: Index, column: str = "name", rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> DataFrame:
    """Each row with the one master id its normalized name stands for (null where none or several do)."""
    one = index.variants.groupBy("key").agg(F.count("*").alias("n"), F.min("master_id").alias("master_id")).where("n = 1").select("key", "master_id")
    keyed = names.withColumn("key", X.match_phrase(X.normalize(F.col(column), rules, unicode), rules))
    few = one.limit(L.BROADCAST_ROWS + 1).count() <= L.BROADCAST_ROWS
    return keyed.join(F.broadcast(one) if few else one, "key", "left").drop("key")
