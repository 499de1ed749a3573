"""Secret scans by grammar inference.

Base patterns find credentials in every whole text. From bounded samples of what they matched (by kind) and of other tokens of the same texts,
probabilistic automata are inferred: states of a prefix tree are merged where next symbols, ends and remaining lengths agree within a Hoeffding bound.
Every candidate of every text, base values and all other runs of TOKEN or more token characters, is then scored: its log-likelihood under the likeliest
credential automaton less that under the automaton of ordinary tokens, for each character. Runs above a threshold are added as spans of kind `model`;
base spans always stay. The threshold keeps all but MISSED of the credentials held out; it is raised, to at most their median, until no more than PASSED
of the ordinary tokens held out exceed it by mistake (see threshold()).

The samples are the values with the lowest hashes of the whole corpus, so they don't depend on how rows are dealt. Null and empty texts have no spans:
counts zero, base_sha256 of the empty string, spans empty, score zero. Repeated rows give repeated results; a null doc_id is kept. With fewer than
FEWEST base values to learn from, nothing is added and every score is zero.
"""

from __future__ import annotations

import hashlib
import re
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, slices, small_reads, table, texts_of
from .words import hashes, runs

KINDS = ("assign", "access", "hex", "model")
#: Values of each kind of credential, and ordinary tokens, that the automata are inferred from; least length of a run; Hoeffding confidence.
EXAMPLES, ORDINARY, TOKEN, ALPHA = 1000, 4000, 8, 0.05
#: Credentials of a kind that an automaton of its own takes (fewer are pooled); credentials in all.
OWN, FEWEST = 20, 8
#: Shares of the held-out credentials below the threshold, and of held-out ordinary tokens above it.
MISSED, PASSED = 0.1, 0.002
#: Share of ordinary tokens, at most, that are left out of their automaton because they are as likely as credentials.
SUSPECT = 0.1

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN, _HEX = np.zeros(128, bool), np.zeros(128, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
#: Symbols of the automata: a-f, g-z, upper case and digits are one symbol each; the rest stand for themselves.
SYMBOLS = "fzA0+/_.=-"
_CLASS = {ord(c): k for cs, k in (("abcdef", "f"), ("ghijklmnopqrstuvwxyz", "z"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "0")) for c in cs}
_CODE = np.zeros(128, np.uint8)
for _c in range(128):
    _CODE[_c] = max(0, SYMBOLS.find(chr(_c).translate(_CLASS)))


def symbols(value: str) -> str:
    return value.translate(_CLASS)


def scan(texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the base spans (start, kind, end) in order; the code points of all texts, where each text starts among them, and starts and ends
    of the runs of token characters that touch no base span."""
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = np.cumsum(size) - size
    low = np.minimum(cp, 127)  # 127 is in neither class
    hex_a, hex_b = runs(_HEX[low])
    keep = hex_b - hex_a >= 24
    hex_a, hex_b = hex_a[keep], hex_b[keep]
    h_of = np.searchsorted(hex_a, np.append(at, len(cp)))
    base, covered = [], np.zeros(len(cp) + 1, np.int32)
    for i, text in enumerate(texts):
        own = [(a, 2, b) for a, b in zip((hex_a[h_of[i] : h_of[i + 1]] - at[i]).tolist(), (hex_b[h_of[i] : h_of[i + 1]] - at[i]).tolist())]
        small = text.lower()
        if any(w in small for w in WORDS):
            own += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            own += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        base.append(sorted(own))
        for a, _, b in own:
            covered[at[i] + a + 1 : at[i] + b + 1] = 1
    a, b = runs(_TOKEN[low])
    keep = b - a >= TOKEN
    a, b = a[keep], b[keep]
    total = np.cumsum(covered)
    free = total[b] == total[a]
    return base, cp, at, a[free], b[free]


def value_of(text: str, span: tuple[int, int, int]) -> str:
    """The credential itself of a base span."""
    start, kind, end = span
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


class Automaton:
    """A probabilistic automaton inferred from strings of SYMBOLS by merging states of their prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.left: list[dict[int, int]] = [{}]  # how many strings have how many symbols left
        self.factor = sqrt(0.5 * log(2 / alpha))
        for s in strings:
            at = 0
            for k, c in enumerate(s):
                self._add(at, len(s) - k)
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.left.append({})
                at = self.next[at][c]
            self._add(at, 0)
        self._merge()

    def _add(self, q: int, left: int, n: int = 1) -> None:
        self.left[q][left] = self.left[q].get(left, 0) + n

    def _total(self, q: int) -> int:
        return sum(self.left[q].values())

    def _distance(self, a: int, b: int) -> float | None:
        """How far two states' frequencies are apart; None where that exceeds the bound."""
        n, m = self._total(a), self._total(b)
        most = self.factor * (1 / sqrt(n) + 1 / sqrt(m))
        apart = 0.0
        for c in self.count[a].keys() | self.count[b].keys():
            gap = abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m)
            if gap > most:
                return None
            apart += gap
        run = worst = 0.0
        for k in sorted(self.left[a].keys() | self.left[b].keys()):
            run += self.left[a].get(k, 0) / n - self.left[b].get(k, 0) / m
            worst = max(worst, abs(run))
        return None if worst > most else apart + worst

    def _compatible(self, p: int, q: int) -> float | None:
        """The distance of two states, if they and all states reached from both agree within the bound."""
        top, stack = None, [(p, q)]
        while stack:
            a, b = stack.pop()
            d = self._distance(a, b)
            if d is None:
                return None
            top = d if top is None else top
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return top

    def _fold(self, p: int, q: int) -> None:
        """Adds the subtree at q to the states from p on."""
        stack = [(p, q)]
        while stack:
            a, b = stack.pop()
            for k, n in self.left[b].items():
                self._add(a, k, n)
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    stack.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        self.states = [0]
        while True:
            inside = set(self.states)
            open_ = [(p, c, q) for p in self.states for c, q in sorted(self.next[p].items()) if q not in inside]
            if not open_:
                break
            parent, c, q = max(open_, key=lambda x: (self._total(x[2]), -self.states.index(x[0]), x[1]))
            near = [(d, p) for p in self.states if (d := self._compatible(p, q)) is not None]
            if near:
                best = min(near)[1]
                self.next[parent][c] = best
                self._fold(best, q)
            else:
                self.states.append(q)
        k, self.table = len(SYMBOLS) + 1, {}
        for q in self.states:
            n = self._total(q)
            log_of = {c: log((self.count[q].get(c, 0) + 0.1) / (n + 0.1 * k)) for c in SYMBOLS}
            self.table[q] = (log_of, self.next[q], log((self.left[q].get(0, 0) + 0.1) / (n + 0.1 * k)))

    def log_likelihood(self, s: str) -> float:
        total, at = 0.0, 0
        for c in s:
            logs, go, _ = self.table[at]
            total += logs[c]
            at = go.get(c, 0)
        return total + self.table[at][2]


class Model:
    """Automata of credentials, the automaton of ordinary tokens, and the least score of an added span."""

    def __init__(self, good: list[Automaton], other: Automaton, least: float = 0.0):
        self.good, self.other, self.least = good, other, least

    def score(self, s: str) -> float:
        """By how much a character of s is likelier under the best credential automaton, as a mean logarithm."""
        return (max(a.log_likelihood(s) for a in self.good) - self.other.log_likelihood(s)) / (len(s) + 1)


def train(credentials: dict[int, list[str]], ordinary: list[str]) -> Model | None:
    """A model of credentials by kind and ordinary tokens, each in an order that doesn't depend on their values; every fourth is held out for the threshold."""
    learn, held = lambda v: [symbols(x) for k, x in enumerate(v) if k % 4 != 3], lambda v: [symbols(x) for x in v[3::4]]
    if sum(map(len, credentials.values())) < FEWEST or not ordinary:
        return None
    groups, pooled = [], []
    for kind in sorted(credentials):
        own = learn(credentials[kind])
        if len(own) >= OWN:
            groups.append(own)
        else:
            pooled += own
    if pooled:
        groups.append(pooled)
    good = [Automaton(sorted(g)) for g in groups]
    known = [s for v in credentials.values() for s in (held(v) or learn(v))]
    # ordinary tokens as likely as credentials may be credentials nobody labelled: where they are few, ordinary tokens are learned without them
    fit = lambda s: max(a.log_likelihood(s) for a in good) / (len(s) + 1)
    least = np.quantile([fit(s) for s in known], MISSED / 2)
    plain = [s for s in learn(ordinary) if fit(s) < least]
    if len(plain) < (1 - SUSPECT) * len(learn(ordinary)):
        plain = learn(ordinary)
    model = Model(good, Automaton(sorted(plain)))
    pos = np.array([model.score(s) for s in known])
    neg = np.array([model.score(s) for s in held(ordinary) or learn(ordinary)])
    model.least = max(0.0, threshold(pos, neg))
    return model


def threshold(pos: np.ndarray, neg: np.ndarray) -> float:
    """The least score, between the quantile MISSED of held-out credentials and their median, that no more than PASSED of the ordinary tokens exceed by
    mistake. Ordinary tokens may hold credentials nobody labelled: as many as lie above the median lie below it, spread as the labelled ones are, so only
    tokens beyond these count as mistakes."""
    median = float(np.median(pos))
    above = int((neg >= median).sum())
    for q in np.linspace(MISSED, 0.5, 41):
        least = float(np.quantile(pos, q))
        mistakes = int(((neg >= least) & (neg < median)).sum()) - above * (0.5 - q) / 0.5
        if mistakes <= PASSED * len(neg):
            return least
    return median


class Lowest:
    """The distinct values of each label with the lowest hashes: most[label] of them. The lowest of a whole are among the lowest of its parts."""

    KINDS = pa.schema([("label", pa.int32()), ("h", pa.int64()), ("value", pa.string())])
    COLUMNS = "label int, h long, value string"

    def __init__(self, most: dict[int, int]):
        self.most = most
        self.held: dict[int, dict[str, int]] = {k: {} for k in most}
        self.bound = dict.fromkeys(most, (1 << 63) - 1)

    def add(self, label: int, h: int, value: str) -> None:
        if h <= self.bound[label]:
            own = self.held[label]
            own[value] = h
            if len(own) > 4 * self.most[label]:
                kept = self.rows(label)
                self.held[label], self.bound[label] = {v: h for _, h, v in kept}, kept[-1][1]

    def rows(self, label: int) -> list[tuple[int, int, str]]:
        return [(label, h, v) for h, v in sorted((h, v) for v, h in self.held[label].items())[: self.most[label]]]

    def batch(self) -> pa.RecordBatch:
        rows = [x for label in self.most for x in self.rows(label)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([],) * 3, self.KINDS)], schema=self.KINDS)


def samples(docs: DataFrame, most: dict[int, int]) -> DataFrame:
    """label (kind of credential, or 3: ordinary), h, value: the most[label] distinct values of each label with the lowest hashes, in one partition.
    Tasks hand on their lowest only, which are merged by hash and then in one task; nothing is written besides the shuffles' own files."""
    ship(docs.sparkSession)
    small_reads(docs.sparkSession)

    def run(batches):
        from xxhash import xxh64_intdigest

        lowest = Lowest(most)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for x, y in slices(texts):
                some = texts[x:y]
                base, cp, _, a, b = scan(some)
                for t, own in zip(some, base):
                    for span in own:
                        value = value_of(t, span)
                        lowest.add(span[1], xxh64_intdigest(value) >> 1, value)
                if len(a):  # each distinct run once
                    _, first = np.unique(hashes(cp, a, b), return_index=True)
                    for i in first.tolist():
                        value = "".join(map(chr, cp[a[i] : b[i]].tolist()))
                        lowest.add(3, xxh64_intdigest(value) >> 1, value)
        yield lowest.batch()

    def merge(batches):
        lowest = Lowest(most)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lowest.add(*row)
        yield lowest.batch()

    found = docs.select("text").mapInArrow(run, Lowest.COLUMNS)
    return found.repartition("h").mapInArrow(merge, Lowest.COLUMNS).repartition(1).mapInArrow(merge, Lowest.COLUMNS)


def infer(docs: DataFrame, examples: int = EXAMPLES, ordinary: int = ORDINARY) -> Model | None:
    """The model learned from at most `examples` base values of each kind and `ordinary` other tokens: those with the lowest hashes."""
    got: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
    for r in samples(docs, {0: examples, 1: examples, 2: examples, 3: ordinary}).collect():  # bounded by EXAMPLES and ORDINARY; in order
        got[r.label].append(r.value)
    return train({k: got[k] for k in (0, 1, 2)}, got[3])


def report(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: counts, the digest of the base spans, all spans, and the best likelihood of a candidate (0 to 1)."""
    ship(docs.sparkSession)
    small_reads(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("score", pa.float64())])

    def run(batches):
        seen: dict[str, float] = {}

        def scored(pattern: str) -> float:
            x = seen.get(pattern)
            if x is None:
                x = model.score(pattern)
                if len(seen) < 200_000 and len(pattern) < 200:
                    seen[pattern] = x
            return x

        for batch in batches:
            texts = texts_of(batch.column(1))
            for x, y in slices(texts):
                some = texts[x:y]
                base, cp, at, a, b = scan(some)
                added: list[list[tuple[int, int, int]]] = [[] for _ in some]
                best = np.full(len(some), -np.inf)
                if model is not None:
                    for i, (t, own) in enumerate(zip(some, base)):
                        for span in own:
                            best[i] = max(best[i], scored(symbols(value_of(t, span))))
                    if len(a):
                        code = _CODE[np.minimum(cp, 127)]
                        _, first, group = np.unique(hashes(code, a, b), return_index=True, return_inverse=True)
                        value = np.array([scored("".join(SYMBOLS[c] for c in code[a[i] : b[i]].tolist())) for i in first.tolist()])[group]
                        doc = np.searchsorted(at, a, "right") - 1
                        np.maximum.at(best, doc, value)
                        for i in np.flatnonzero(value >= model.least).tolist():
                            d = int(doc[i])
                            added[d].append((int(a[i] - at[d]), 3, int(b[i] - at[d])))
                rows = []
                for own, more, top in zip(base, added, best.tolist()):
                    n = [sum(k == kind for _, k, _ in own) for kind in range(3)]
                    text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own)
                    every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(own + more))
                    rows.append((*n, hashlib.sha256(text.encode()).hexdigest(), every, 0.0 if top == -np.inf else 1 / (1 + exp(-top))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(kinds)[1:]))], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, score double")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, infer(docs))
