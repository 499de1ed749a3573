"""Pairs within buckets without emitting them, and components of the links found.

Rows that share a key are compared in tasks of bounded size: a bucket over `block` rows is split by hash into sub-blocks, and each pair of
sub-blocks is a unit of its own; many small units go to one task. A task gives, per row, sums over its links and one edge to the least node it
reached there, so its output is linear in its input, whatever the size of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, ship

#: Rows of one bucket that are compared in one unit with one another.
BLOCK = 1024
#: Rows of units that go to one task.
TASK_ROWS = 4096
#: Large buckets of which the list is broadcast at most; beyond that the join is shuffled.
BROADCAST_ROWS = 100_000
#: Pairs that are held at once.
PAIRS = 1 << 15


def pairs_by_unit(unit: np.ndarray, side: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of rows of one unit, at most `most` at a time; unit is sorted. Rows of two sub-blocks pair only across them."""
    left, step, kept, size = np.arange(len(unit)), 1, [], 0
    while True:
        left = left[left + step < len(unit)]
        left = left[unit[left] == unit[left + step]]
        if not len(left):
            break
        i, j = left, left + step
        cross = (side[i] < 0) | (side[i] != side[j])
        kept.append((i[cross], j[cross]))
        size += int(cross.sum())
        if size >= most:
            yield np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
            kept, size = [], 0
        step += 1
    if size:
        yield np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])


def least_reached(n: int, i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row, the least node it reaches over the links (i, j)."""
    out = node.copy()
    while len(i):
        low = np.minimum(out[i], out[j])
        if (low == out[i]).all() and (low == out[j]).all():
            break
        np.minimum.at(out, i, low)
        np.minimum.at(out, j, low)
    return out


def compare(rows: DataFrame, prepare: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows: key long, node long, weight long and what `prepare` reads. Gives node, links (sum of the weights of linked rows) and least (a node it
    reaches), for rows with a link; a node may come several times. prepare(table) gives linked(i, j), which says
    which pairs of its rows count."""
    ship(rows.sparkSession)
    sizes = rows.groupBy("key").count()
    large = cut(sizes.where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    found = large.count()
    units = max(1, -(-rows.count() // task_rows))
    if found:
        side = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
        rows = rows.join(F.broadcast(large) if found <= BROADCAST_ROWS else large, "key", "left")
        rows = rows.withColumn("side", F.when(F.col("parts").isNotNull(), side).otherwise(0))
        rows = rows.withColumn("other", F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))))
        low, high = F.least("side", "other"), F.greatest("side", "other")
        rows = rows.withColumn("unit", F.xxhash64("key", low, high)).withColumn("side", F.when(low == high, -1).otherwise(F.col("side"))).drop("parts", "other", "key")
        units = max(units, -(-rows.count() // task_rows))
    else:
        rows = rows.withColumn("unit", F.col("key")).withColumn("side", F.lit(-1)).drop("key")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("unit", "ascending"), ("node", "ascending")]).combine_chunks()
        unit, side, node, weight = (t[c].to_numpy() for c in ("unit", "side", "node", "weight"))
        linked = prepare(t)
        links, ii, jj = np.zeros(len(unit), np.int64), [], []
        for i, j in pairs_by_unit(unit, side):
            ok = linked(i, j)
            i, j = i[ok], j[ok]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            ii.append(i)
            jj.append(j)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ii, jj))
        least = least_reached(len(unit), i, j, node)
        own = np.flatnonzero(links)
        return pa.table([node[own], links[own], least[own]], schema=schema)

    dealt = rows.withColumn("task", F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(units)))
    return dealt.groupBy("task").applyInArrow(run, "node long, links long, least long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of all nodes of edges (node, least), both long; nodes without edges don't appear.

    Alternates the large-star and the small-star step on the edge table until it no longer changes; each round is written in the shared folder.
    A hub's rows are in a join only, which Spark splits where they are many; minima are combined before the shuffle.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(low, "a")
        if large:
            return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = cut(edges.where("node <> least").select(F.greatest("node", "least").alias("a"), F.least("node", "least").alias("b")).distinct())
    was = mark(now)
    while was[0]:
        after = cut(star(star(now, True), False))
        drop(now)
        now, seen = after, mark(after)
        if seen == was:
            break
        was = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
