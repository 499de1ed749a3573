"""Sum-of-squares packing of documents into fixed-length sequences.

Each document is encoded and ends with an end token; what exceeds a sequence is cut so that every piece but the first is full. Pieces are dealt by
hash into shards of bounded size; within a shard, longest first, each piece goes into the open sequence where the sum over gaps of the squared number
of open sequences with that gap becomes smallest; a new sequence is opened where none has room. (With a new sequence as one more choice at any time,
as for lengths that arrive in random order, lengths in descending order need more sequences.) A shard's state is one counter and one stack for each gap.

Null and empty texts give the end token alone. Equal rows are pieces of their own. A null doc_id is kept. Only the columns doc_id and text are read.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, ship, slices, table, texts_of
from .pieces import Packed

CAPACITY, END_ID, SHARD = 1024, 2, 16_384


@cache
def _worker(path: str) -> Packed:
    """Ids by the tokenizers library, one piece of its own pre-tokenization at a time."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    model = made.model
    letters = byte_letters()
    return Packed(lambda piece: [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))])


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next free code point from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in seen}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


def special_id(path: str) -> dict[str, int]:
    import json

    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all pieces of all documents."""
    ship(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    special = special_id(path)

    def encoded(packed, texts):
        if not any(s in t for s in special for t in texts):
            yield from packed.texts(texts)
            return
        import regex

        mark = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        for t in texts:  # a special token written in a text is one id, as the library has it
            parts = [p for p in mark.split(t) if p]
            yield b"".join(np.array([special[p]], "<u4").tobytes() if p in special else next(packed.texts([p])) for p in parts)

    def run(batches):
        packed, end = _worker(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, ids = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in slices(texts):
                rows = []
                for doc, data in zip(ids[a:b], encoded(packed, texts[a:b])):
                    data += end
                    for k, (s, n) in enumerate(cut_lengths(len(data) // 4, capacity)):
                        rows.append((doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the order given. Ties go to the smaller gap that is left."""
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # the sum changes by 2 * (gaps[h - n] - gaps[h] + 1) where gap h becomes h - n, and by one less step where it closes
        change = gaps[: capacity + 1 - n] - gaps[n:] + 1.0
        change[0] = 0.5 - gaps[n]
        change[gaps[n:] == 0] = np.inf
        h = int(change.argmin())
        if change[h] < np.inf:
            h += n
            s = stacks[h].pop()
            gaps[h] -= 1
        else:
            h, s, made = capacity, made, made + 1
        where[i], offset[i] = s, capacity - h
        if h > n:
            gaps[h - n] += 1
            stacks[h - n].append(s)
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length; any number of rows, `shard` to a task."""
    ship(pieces.sparkSession)
    pieces = cut(pieces)
    shards = max(1, -(-pieces.count() // shard))
    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def run(got: pa.Table) -> pa.Table:
        got = got.combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = sum_of_squares(got["length"].to_numpy(), capacity)
        base = got["shard"][0].as_py() << 32
        return got.drop_columns(["shard"]).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(document_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
