"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments of two bits, and the bit counts of the segments are its point. The Manhattan distance of two points
is at most the fingerprints' Hamming distance. The segments form `groups` groups; two points within distance d differ in at most d groups, so they
lie in the same unit cell of the grid over some `groups - d` groups. Cells of all such projections are the keys of the range join; pairs of a cell
are kept by Manhattan distance, then by exact Hamming distance. No pair within d bits is lost, whatever the number of groups; more groups make more
but smaller cells, so their number follows from that of the distinct fingerprints.

Null and empty texts have no words and the fingerprint zero, which links like any other. Repeated rows give repeated results. A row with a null
doc_id gets its fingerprint and its component; component_id is the smallest doc_id that is not null (null if there is none).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import compare, components
from .common import cut, ship, slices, table, texts_of

BITS, WORDS, SEED = 3, 3, 42
#: Fewest and most groups; bits of collision entropy of one segment's count (0, 1, 2 with shares 1/4, 1/2, 1/4).
GROUPS, MOST_GROUPS, ENTROPY = 6, 12, -np.log2(3 / 8)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text: a bit is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    got = text.encode().lower().split()  # bytes: A-Z only, and white space is ASCII only
    if not got:
        return 0
    joined = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(got) - words + 1)
    last = ends[words - 1 :] if len(got) >= words else ends[-1:]
    total, ones = 0, np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist()))
    for k in range(0, n, 8192):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans[k : k + 8192]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""
    ship(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments, as one row of bytes each."""
    bits = np.unpackbits(np.ascontiguousarray(fp, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 32, 2).sum(2, dtype=np.uint8)


def cells(points: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """A 64-bit key of each point's cell in each projection (rows, projections)."""
    # a group's counts as one number in base 3, then the groups of a projection mixed
    parts = np.array_split(np.arange(points.shape[1]), groups)
    code = [(points[:, p].astype(np.uint64) * np.uint64(3) ** np.arange(len(p), dtype=np.uint64)).sum(1, dtype=np.uint64) for p in parts]
    out = []
    for k, chosen in enumerate(combinations(range(groups), groups - bits)):
        h = np.full(len(points), k + 1, np.uint64)
        for g in chosen:
            h = (h ^ code[g]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.stack(out, 1).view(np.int64)


def groups_for(n: int, bits: int = BITS) -> int:
    """The number of groups with the least work: keys of a row, each with itself and the mates to expect among n fingerprints."""
    return min(range(max(GROUPS, bits + 1), max(MOST_GROUPS, bits + 2) + 1), key=lambda g: comb(g, bits) * (1 + n / 2 ** (ENTROPY * 32 * (g - bits) / g)))


def near_fingerprints(distinct: DataFrame, bits: int = BITS, groups: int = GROUPS) -> DataFrame:
    """node, links and least of the distinct fingerprints (node long, weight long) that have another within `bits` bits."""
    kinds = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("weight", pa.int64())])

    def keyed(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for a in range(0, len(fp), 8192):
                key = cells(popcounts(fp[a : a + 8192]), bits, groups)
                n, weight = key.shape[1], batch.column(1).to_numpy()[a : a + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp[a : a + 8192], n)), pa.array(np.repeat(weight, n))], schema=kinds)

    def prepare(t: pa.Table):
        fp = t["node"].to_numpy()
        point = popcounts(fp).astype(np.int8)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            near = np.abs(point[i] - point[j]).sum(1) <= bits
            near[near] = np.bitwise_count(fp[i[near]].view(np.uint64) ^ fp[j[near]].view(np.uint64)) <= bits
            return near

        return linked

    return compare(cut(distinct.mapInArrow(keyed, "key long, node long, weight long")), prepare)


def simhash_components(docs: DataFrame, bits: int = BITS, groups: int | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    rows = cut(fingerprints(docs))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = near_fingerprints(distinct.select(F.col("fp").alias("node"), F.lit(1).cast("long").alias("weight")), bits, groups or groups_for(distinct.count(), bits))
    roots = components(edges.select("node", "least"))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
