"""Near-duplicate groups by the Jaccard similarity of five-word shingles: op10 with exact verification, for the pipeline.

Texts of equal shingle sets are one node. Candidates come from SimHash (op10): nodes whose fingerprints over five-word shingles lie within its radius are
linked by its segment-popcount range join. That finds few of the pairs at similarity 0.8, whose fingerprints are 10 of 64 bits apart on average, so
MinHash bands complete it: of nodes that share a band, those whose sketches agree in LEAST_ALIKE of their values are linked too. Within the components of
these links every pair is compared exactly on its shingles (as 64-bit hashes) unless it is connected already. Fingerprints and sketches only choose what
is compared: at similarity 0.8 all bands miss a pair with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.

Words are runs of letters, digits and underscores, in lower case. A text of fewer words than a shingle is one shingle; one without words is its
other tokens. Null and empty texts are alike. Rows without a doc_id take no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare, components
from .common import cut, drop, ship, texts_of
from .op10_simhash import groups_for, near_fingerprints

#: Words of a shingle; least similarity as a fraction.
WORDS, OVER, UNDER = 5, 4, 5
#: Bands and minima of each; minima (of BANDS * ROWS, one byte each) that must agree: at similarity 0.8 fewer do with probability under 1e-7.
BANDS, ROWS, LEAST_ALIKE = 24, 4, 53
#: Rows of a task that compares shingles.
EXACT_ROWS = 1024

WORD = re.compile(r"\w+")
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    got = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())]
    if not got:
        return np.array([xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"))], np.uint64)
    joined = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[words - 1 :] if len(got) >= words else ends[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted distinct arrays is at least OVER / UNDER."""
    small, large = sorted((len(a), len(b)))
    if small * UNDER < large * OVER:
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared * UNDER >= (small + large - shared) * OVER


def node_of(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes())


def sketch(hashes: np.ndarray) -> bytes:
    """A key of each band, then one byte of each minimum."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        np.minimum(low, (FACTORS[:, None] * hashes[None, k : k + 4096]).min(1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.astype("<u8").tobytes() + (low & np.uint64(255)).astype(np.uint8).tobytes()


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles: a bit is set if it is in over half of their hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, sketch and fingerprint of each row."""
    ship(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            node, made, prints = [], [], []
            for t in texts_of(batch.column(1)):
                h = shingles(t)
                node.append(node_of(h))
                made.append(sketch(h))
                prints.append(simhash(h))
            node, prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(made, pa.binary()), prints], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, sketch binary, fp long")


def close_prints(distinct: DataFrame) -> DataFrame:
    """node and least of nodes (node, fp) whose fingerprints are equal or within op10's radius; one node stands for all of a fingerprint."""
    prints = cut(distinct.groupBy("fp").agg(F.min("node").alias("head")))
    found = near_fingerprints(prints.select(F.col("fp").alias("node"), F.lit(1).cast("long").alias("weight")), groups=groups_for(prints.count()))
    ends = [prints.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in ("node", "least")]
    apart = found.select("node", "least").distinct().join(ends[0].hint("shuffle_hash"), "node").join(ends[1].hint("shuffle_hash"), "least").select(F.col("node_head").alias("node"), F.col("least_head").alias("least"))
    same = distinct.select("node", "fp").join(prints.hint("shuffle_hash"), "fp").where("node <> head").select("node", F.col("head").alias("least"))
    return apart.union(same)


def alike(distinct: DataFrame) -> DataFrame:
    """node and least of the nodes (node, sketch) that share a band with another of a like sketch."""
    kinds = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                key = np.stack([np.frombuffer(s, "<i8", BANDS) for s in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], schema=kinds)

    def prepare(t: pa.Table):
        made = t["sketch"].to_pylist()
        low = np.stack([np.frombuffer(s, np.uint8, BANDS * ROWS, 8 * BANDS) for s in made]) if made else np.empty((0, BANDS * ROWS), np.uint8)
        return lambda i, j: (low[i] == low[j]).sum(1) >= LEAST_ALIKE

    every = cut(distinct.select("node", "sketch").mapInArrow(keyed, "key long, node long"))
    several = every.groupBy("key").count().where("count > 1").select("key")
    shared = every.join(several.hint("shuffle_hash"), "key", "left_semi")
    rows = cut(distinct.select("node", "sketch").join(shared.hint("shuffle_hash"), "node").select("key", "node", F.lit(1).cast("long").alias("weight"), "sketch"))
    drop(every)
    return compare(rows, prepare).select("node", "least")


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node and least of members (node, first, root) that are similar to another of the same root; first is the doc_id of one of a node's texts."""
    kinds = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("weight", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for t, node, root in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h = shingles(t)
                if np.uint64(node_of(h)).view(np.int64) == node:  # a doc_id may have other texts
                    out.append((root, node, 1, h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else ([],) * 4, kinds)], schema=kinds)

    def prepare(t: pa.Table):
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        up = list(range(len(sets)))

        def top(i):
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), bool)
            for n, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                a, b = top(x), top(y)
                if a != b and similar(sets[x], sets[y]):
                    up[max(a, b)] = min(a, b)
                    out[n] = True
            return out

        return linked

    texts = docs.select(F.col("doc_id").cast("long").alias("first"), "text").join(members.hint("shuffle_hash"), "first").select("text", "node", "root")
    rows = cut(texts.mapInArrow(run, "key long, node long, weight long, shingles binary"))
    return compare(rows, prepare, task_rows=EXACT_ROWS).select("node", "least")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of each row with a doc_id."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    rows = cut(sketches(docs))
    distinct = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")))
    near = components(alike(distinct).union(close_prints(distinct)))
    near = near.union(near.select("root", "root").distinct())
    members = cut(distinct.select("node", "first").join(near.hint("shuffle_hash"), "node"))
    roots = components(verified(docs, members))
    named = cut(distinct.select("node", "first").join(roots.hint("shuffle_hash"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
