"""Embedding near-duplicates by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; the hash is the signed axis nearest to it. A table joins two
such hashes into one bucket; each vector also enters the buckets of its next likely hashes (multiprobe). Vectors that share a bucket are compared
exactly, in double precision; a pair found in several buckets counts in the first of them only, which each task can tell from the two vectors.

A vector that is null, zero, or holds a null or non-finite component links with nothing. Equal vectors are one class with its number of vectors.
Repeated rows of one vec_id are one vector; a vec_id with several vectors has a row of its own, and a component, for each. A null vec_id takes no part: its row has null ids, no links and kept null. Vectors are padded with
zeros to a power of two; vectors of different lengths never link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import compare, components
from .common import cut, ship, table

COSINE, TABLES, PROBES, SEED = 0.9, 8, 3, 5


def usable(column: str) -> "F.Column":
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket keys, the most likely first."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = unit
    rng, out = np.random.default_rng(seed), np.empty((n, tables, probes), np.int64)
    m = min(probes, width)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(-size, m - 1, axis=1)[:, :m]
            value = np.take_along_axis(size, top, 1)
            order = np.lexsort((top, -value), axis=1)
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            axes.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
            gaps.append((value[:, :1] - value) ** 2)
        cost = (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(n, -1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        a, b = np.take_along_axis(axes[0], pick // m, 1), np.take_along_axis(axes[1], pick % m, 1)
        out[:, t, : pick.shape[1]] = ((d * 64 + t) * 2 * width + a) * 2 * width + b
        out[:, t, pick.shape[1] :] = out[:, t, :1]
    return out


def linked_vectors(classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """node, links and least for classes (node long, weight long, embedding array<double or float>) with a link."""
    kind = classes.schema["embedding"].dataType.simpleString()
    kinds = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("weight", pa.int64()), ("embedding", pa.list_(pa.float64() if "double" in kind else pa.float32()))])

    def keyed(batches):
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                for a in range(0, own.num_rows, 4096):
                    part = own.slice(a, 4096)
                    key = bucket_keys(unit_rows(matrix(part.column(2))), tables, probes)
                    for k in range(probes):  # a bucket of a table only once for each vector
                        for t in range(tables):
                            new = np.flatnonzero((key[:, t, :k] != key[:, t, k : k + 1]).all(1))
                            some = part.take(pa.array(new))
                            yield pa.RecordBatch.from_arrays([pa.array(key[new, t, k]), some.column(0), some.column(1), some.column(2).cast(kinds.field(3).type)], schema=kinds)

    def prepare(t: pa.Table):
        # a key holds the vectors' length, so those of a pair have one length; a task may hold several
        column = t["embedding"].combine_chunks()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        bucket, never = t["bucket"].to_numpy(), np.iinfo(np.int64).max
        unit = [np.empty(0)] * len(sizes)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            for r, u in zip(rows.tolist(), unit_rows(matrix(column.take(pa.array(rows))))):
                unit[r] = u
        keys = np.zeros((len(sizes), tables, probes), np.int64)
        known = np.zeros(len(sizes), bool)

        def need(rows: np.ndarray) -> None:
            """The keys of rows that have a link, each computed once."""
            rows = np.unique(rows)
            rows = rows[~known[rows]]
            for d in np.unique(sizes[rows]):
                own = rows[sizes[rows] == d]
                keys[own] = bucket_keys(np.stack([unit[r] for r in own.tolist()]), tables, probes)
            known[rows] = True

        whole = np.stack(unit) if len(np.unique(sizes)) == 1 else None

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), bool)
            for s in range(0, len(i), 8192):
                a, b = i[s : s + 8192], j[s : s + 8192]
                cos = np.einsum("ij,ij->i", whole[a], whole[b]) if whole is not None else np.array([unit[x] @ unit[y] if sizes[x] == sizes[y] else -1.0 for x, y in zip(a.tolist(), b.tolist())])
                near = np.flatnonzero(cos >= cosine)
                if not len(near):
                    continue
                a, b = a[near], b[near]
                need(np.append(a, b))
                first = np.full(len(near), never)
                for tab in range(tables):
                    open_ = np.flatnonzero(first == never)
                    if not len(open_):
                        break
                    ka, kb = keys[a[open_], tab], keys[b[open_], tab]
                    same = (ka[:, :, None] == kb[:, None, :]).any(2)
                    hit = same.any(1)
                    first[open_[hit]] = np.where(same[hit], ka[hit], never).min(1)
                out[s + near] = first == bucket[a]
            return out

        return linked

    rows = cut(classes.select("node", "weight", "embedding").mapInArrow(keyed, f"key long, node long, weight long, embedding {kind}"))
    return compare(rows.withColumn("bucket", F.col("key")), prepare)


def embedding_components(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable("embedding"), F.col("embedding")).alias("embedding"))
    live = rows.where("vec_id is not null and embedding is not null")
    # classes are known by a hash of their vector: one vec_id may come with several vectors
    classes = cut(live.distinct().groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("node", F.xxhash64("embedding")))
    found = cut(linked_vectors(classes, cosine, tables, probes))
    roots = components(found.select("node", "least"))
    more = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(more, "node", "left").join(roots, "node", "left")
    named = cut(named.select("embedding", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select("embedding", "n_links", F.col("least").alias("root"))
    out = rows.join(named, "embedding", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    n = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op5_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
