"""Quality classification by co-training.

Two views of a document are classified apart: its text (shares of capitals, symbols, repeats and the like) and its metadata (source, language,
length). In each round both views score every unlabelled document, and each hands the NEW it is surest of to the other to learn from. At last each view
is calibrated, and the two are combined, on labelled rows that neither learned from; every document is scored.

Fitting uses at most SAMPLE labelled rows, those with the lowest hash of their doc_id. Conflicting labels of one doc_id count by their mean; null labels
are ignored; of rows that share a labelled doc_id the one with the least hash teaches. Equal unlabelled rows teach as one may. A null or empty text has
zero text features; null metadata is a value of its own. Repeated rows are scored alike; a null doc_id is scored but teaches nothing. Without labels of
both classes every score is 0.5 and every document is kept. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop, ship, slices, table, texts_of, without
from .words import hashes, joined, runs

SAMPLE, NEW, ROUNDS, KEEP = 12_000, 1200, 4, 0.5
#: Least logit, either way, of what a view hands on.
SURE = 2.2
#: Hashed columns for source and for language.
SOURCES, LANGS = 64, 16

_SPACE, _UPPER, _LETTER, _SYMBOL, _DIGIT, _POINT = (np.zeros(256, bool) for _ in range(6))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_DIGIT[0x30:0x3A] = True
_POINT[[ord(c) for c in ".,;:'\"()?-"]] = True
_SYMBOL[0x21:0x7F] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _POINT)


def text_features(texts: list[str]) -> np.ndarray:
    """Shares over a text's bytes and words, in one pass over all texts."""
    data, at = joined(texts, lower=False)
    n, size = len(texts), np.diff(np.append(at, len(data)))
    space = _SPACE[data]
    start, stop = runs(~space)
    doc = np.searchsorted(at, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    per_word = np.maximum(words, 1)
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), at) if n else np.empty(0)
    total = lambda x: np.bincount(doc, x, n)
    if len(start):
        inside = lambda mask: (s := np.append(0, np.cumsum(mask)))[stop] - s[start]
        upper, letters, symbols = inside(_UPPER[data]), inside(_LETTER[data]), inside(_SYMBOL[data])
        h = hashes(data, start, stop)
        same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        order = np.lexsort((h, doc))
        fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
        distinct = np.bincount(doc[order][fresh], minlength=n)
    else:
        upper = letters = symbols = same = np.empty(0, np.int64)
        distinct = np.zeros(n)
    lines = count(data == 10)
    columns = [
        total((upper >= 2) & (upper == letters) | (upper >= 3)) / per_word, total(symbols > 0) / per_word, total((symbols > 0) & (letters == 0)) / per_word, total(symbols >= 3) / per_word, total(same) / per_word,
        distinct / per_word, distinct / np.sqrt(per_word), count(_SYMBOL[data]) / size, count(_UPPER[data]) / size, count(_DIGIT[data]) / size, count(_POINT[data]) / size, total(stop - start) / per_word / 10,
        lines / per_word, np.log1p(words) / 5, total((letters == 1) & (stop - start == 1)) / per_word, (words <= 5).astype(float), (words <= 1).astype(float),
    ]
    x = np.stack([np.asarray(c, float) for c in columns], 1)
    return np.concatenate([x, np.minimum(np.sqrt(np.maximum(x[:, :5], 0)), 1), (x[:, :5] > 0.02).astype(float)], 1)


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    size = np.array([0.0 if c is None else float(c) for c in n_chars])
    out = np.zeros((len(size), SOURCES + LANGS + 4))
    rows = np.arange(len(size))
    out[rows, [zlib.crc32(str(s).encode()) % SOURCES for s in source]] = 1
    out[rows, [SOURCES + zlib.crc32(str(s).encode()) % LANGS for s in lang]] = 1
    z = np.log1p(np.maximum(size, 0)) / 5
    out[:, -4:] = np.stack([z, z**2, [c is None for c in n_chars], size == 0], 1)
    return out


class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self._with_one(x)
        w = np.zeros(x.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            move = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            w += np.clip(move, -5, 5)
        self.w = w

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -10, 10), np.ones((len(x), 1))], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._with_one(x) @ self.w, -30, 30)


class CoTraining:
    """Two views that teach each other. Of the labelled rows, two of four teach from the start, one calibrates the views, one their combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.views, self.y, part = [text, meta], y, np.arange(len(y)) % 4
        self.calibrate, self.combine = part == 2, part == 3
        self.x, self.t = [v[part < 2] for v in self.views], [y[part < 2]] * 2
        self.base = float(np.clip(y.mean(), 0.02, 0.98))
        self.models = [Logistic(a, b) for a, b in zip(self.x, self.t)]

    def teach(self, k: int, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        """Rows that view k has labelled join the other view's."""
        other = 1 - k
        self.x[other] = np.concatenate([self.x[other], (text, meta)[other]])
        self.t[other] = np.concatenate([self.t[other], y])

    def refit(self) -> None:
        self.models = [Logistic(a, b) for a, b in zip(self.x, self.t)]

    def finished(self):
        """The two views, their calibrations and the combination."""
        logits = lambda rows: np.stack([m.logit(v[rows]) for m, v in zip(self.models, self.views)], 1)
        z = logits(self.calibrate)
        calibration = [Logistic(z[:, k : k + 1], self.y[self.calibrate]) for k in (0, 1)]
        z = logits(self.combine)
        return self.models, calibration, Logistic(np.stack([c.logit(z[:, k : k + 1]) for k, c in enumerate(calibration)], 1), self.y[self.combine])


def score(model, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Columns: calibrated text view, calibrated metadata view, both together."""
    if model is None:
        return np.full((len(text), 3), 0.5)
    models, calibration, both = model
    z = np.stack([c.logit(m.logit(v)[:, None]) for m, c, v in zip(models, calibration, (text, meta))], 1)
    z = np.concatenate([z, both.logit(z)[:, None]], 1)
    return 1 / (1 + np.exp(-z))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the row, its text features, and the columns of its metadata view; rows without a doc_id are left out."""
    kinds = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("t", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(5))
            for a, b in slices(texts):
                x = text_features(texts[a:b]).astype(np.float32)
                t = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(5)), t], schema=kinds)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text", "source", "lang", "n_chars"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), "text")
    return rows.toDF("doc_id", "h", "source", "lang", "n_chars", "text").mapInArrow(run, "doc_id long, h long, source string, lang string, n_chars long, t array<float>")


def arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The two views of rows of features()."""
    text = rows["t"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
    return text, meta_features(*(rows[c].to_pylist() for c in ("source", "lang", "n_chars")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, new: int = NEW):
    """The model; None without at least 8 labelled rows of both classes."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    rows = cut(features(docs).join(known, "doc_id", "left"))
    # of rows that share a labelled doc_id, the one with the least hash
    one = rows.where("quality is not null").groupBy("doc_id", "quality").agg(F.min_by(F.struct("source", "lang", "n_chars", "t", "h"), "h").alias("r")).select("doc_id", "quality", "r.*")
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()  # at most `sample` rows
    y = some["quality"].to_numpy().astype(float)
    if len(y) < 8 or (y >= 0.5).all() or (y < 0.5).all():
        return None
    co, taken = CoTraining(*arrays(some), y), []
    fields = ["doc_id", "h", "source", "lang", "n_chars", "t"]
    rest = rows.where("quality is null").select(*fields)
    # as many of each label as their share among the labelled rows
    each = (int(new * (1 - co.base)) + 1, int(new * co.base) + 1)
    for _ in range(rounds):
        models, used = co.models, np.sort(np.array(taken, np.int64))

        def run(batches, models=models, used=used):
            for batch in batches:
                if batch.num_rows:
                    views = arrays(pa.Table.from_batches([batch]))
                    z = [pa.array(m.logit(v)) for m, v in zip(models, views)]
                    free = ~np.isin(batch.column(1).to_numpy(), used)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *z], names=[*batch.schema.names, "z0", "z1"]).filter(pa.array(free))

        # every unlabelled document is scored in every round; each view hands on those it is surest of
        scored = cut(rest.mapInArrow(run, "doc_id long, h long, source string, lang string, n_chars long, t array<float>, z0 double, z1 double"))
        found = 0
        for k in (0, 1):
            z = F.col(f"z{k}")
            low = scored.where(z < -SURE).orderBy(z, "h").limit(each[0]).toArrow()  # at most NEW rows a view and round
            high = scored.where(z > SURE).orderBy(z.desc(), "h").limit(each[1]).toArrow()
            both = pa.concat_tables([low, high])
            if both.num_rows:
                co.teach(k, *arrays(both), np.append(np.zeros(low.num_rows), np.ones(high.num_rows)))
                taken += both["h"].to_pylist()
                found += both.num_rows
        drop(scored)
        if not found:
            break
        co.refit()
    drop(rows)
    return co.finished()


def score_documents(docs: DataFrame, model) -> DataFrame:
    """All columns, with text_score, meta_score and quality_score (probability of good quality), which replace input columns of these names."""
    ship(docs.sparkSession)
    names = ["text_score", "meta_score", "quality_score"]
    docs = without(docs, names)
    schema = StructType([*docs.schema.fields])
    for c in names:
        schema = schema.add(c, "double")
    place = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")}

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(place["text"]))
            meta = meta_features(*(batch.column(place[c]).to_pylist() for c in ("source", "lang", "n_chars")))
            got = [score(model, text_features(texts[a:b]), meta[a:b]) for a, b in slices(texts)]
            got = np.concatenate(got) if got else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, k]) for k in range(3))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars"), model)
    return scored.select("doc_id", "text_score", "meta_score", "quality_score", (F.col("quality_score") >= KEEP).alias("kept"))
