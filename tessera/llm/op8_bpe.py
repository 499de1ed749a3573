"""Byte-level BPE encoding and decoding by Aho-Corasick matches and backtracking.

A token sequence is what BPE merges give exactly if each adjacent pair is what the merges give for that pair alone. So the encoder takes the
longest match at each place, tests it against the token before (memoised), steps to shorter matches or back where no match fits, and visits each
place of a piece a bounded number of times. Bytes are mapped to Latin-1 characters for the automaton.

Null text counts as empty: no ids, and the digests of no bytes. Any row gives one row, so repeated rows repeat. A null doc_id is kept.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, slices, table, texts_of
from .pieces import Packed

#: Bound of the memoised pair tests in one worker; beyond it pairs are tested again.
PAIRS = 1_000_000
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BacktrackingBPE:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.pairs, self.whole, self.spines = ranks, {}, {}, {}
        self.vocab = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.flat = None
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The merges, lowest rank first, written plainly; used on one or two tokens only. It ends early where `stop` parts are left."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > stop:
            least, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge(self, data: bytes) -> list[int]:
        return [self.ranks[p] for p in self.merged(data)]

    def stands(self, token: int) -> bool:
        got = self.whole.get(token)
        if got is None:
            got = self.whole[token] = self.merge(self.vocab[token]) == [token]
        return got

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """The parts at one edge of a token as its merges grow it, with their ranks; None if a part is ranked above its whole."""
        key = token * 2 + right
        if key not in self.spines:
            t, out = self.vocab[token], []
            while t:
                out.append((t, self.ranks[t]))
                if len(t) == 1:
                    break
                parts = self.merged(t, stop=2)
                if len(parts) != 2 or max(map(self.ranks.__getitem__, parts)) >= self.ranks[t]:
                    out = None
                    break
                t = parts[right]
            self.spines[key] = out and out[::-1]
        return self.spines[key]

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.pairs.get(key)
        if got is None:
            got = self._fits(left, right)
            if len(self.pairs) < PAIRS:
                self.pairs[key] = got
        return got

    def _fits(self, left: int, right: int) -> bool:
        """Replays the merges at the border of two tokens: they stay apart if no merge across it comes first (ties: the leftmost merge is first)."""
        a, b = self.spine(left, True), self.spine(right, False)
        if a is None or b is None:
            return self.merge(self.vocab[left] + self.vocab[right]) == [left, right]
        i = j = 0
        while True:
            across = self.ranks.get(a[i][0] + b[j][0])
            ra = a[i + 1][1] if i + 1 < len(a) else _NEVER
            rb = b[j + 1][1] if j + 1 < len(b) else _NEVER
            if across is not None and across < ra and across <= rb:
                return False
            if ra == rb == _NEVER:
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1

    def encode_bytes(self, data: bytes) -> list[int]:
        if (r := self.ranks.get(data)) is not None:
            return [r]
        n, length = len(data), self.length
        at: list[list[int]] = [[] for _ in range(n)]  # the matches that start here, by length
        for end, i in self.automaton.iter(data.decode("latin-1")):
            at[end + 1 - length[i]].append(i)
        open_, tokens, tried, pos = bytearray(b"\1") * (n + 1), [], [], 0
        k = len(at[0]) - 1  # the match to try next
        while pos < n:
            here, last = at[pos], tokens[-1] if tokens else -1
            while k >= 0:
                t = here[k]
                if open_[pos + length[t]] and (self.stands(t) if last < 0 else self.fits(last, t)):
                    break
                k -= 1
            if k >= 0:
                tokens.append(t)
                tried.append(k)
                pos += length[t]
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte")
                open_[pos] = 0
                pos -= length[tokens.pop()]
                k = tried.pop() - 1
        return tokens

    def encode(self, piece: str) -> list[int]:
        return self.encode_bytes(piece.encode())

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from one flat copy of the vocabulary."""
        if self.flat is None:
            most = max(self.vocab) + 1
            tokens = [self.vocab.get(i, b"") for i in range(most)]
            size = np.fromiter(map(len, tokens), np.int64, most)
            self.flat = np.frombuffer(b"".join(tokens), np.uint8), size, np.cumsum(size) - size
        data, size, at = self.flat
        n = size[ids]
        end = np.cumsum(n)
        return data[np.repeat(at[ids] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()


@cache
def _worker(path: str) -> tuple[BacktrackingBPE, Packed]:
    bpe = BacktrackingBPE(read_ranks(path))
    return bpe, Packed(bpe.encode, 600_000)


def bpe_round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; keep_ids adds the ids (array of int)."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    kinds = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    kinds = pa.schema(kinds + [pa.field("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches):
        bpe, packed = _worker(path)
        for batch in batches:
            texts, ids = texts_of(batch.column(1)), batch.column(0)
            for a, b in slices(texts):
                rows = []
                for data in packed.texts(texts[a:b]):
                    got = np.frombuffer(data, "<u4")
                    rows.append((len(got), hashlib.sha256(data).hexdigest(), hashlib.sha256(bpe.decode(got)).hexdigest(), got.astype(np.int32) if keep_ids else None))
                n, x, y, z = zip(*rows)
                out = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(x), pa.array(y)] + [pa.array(z, pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays(out, schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
