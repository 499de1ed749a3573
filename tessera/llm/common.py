"""Shared pieces: cutting lineage in the cluster's shared folder, shipping the package to executors, batching of long texts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once; one longer text makes a slice of its own.
SLICE_CHARS = 1 << 18
#: Rows of an Arrow batch, where the session has Spark's default.
BATCH_ROWS = 2000
#: Rows that a Parquet reader holds at once where whole texts are read, where the session has Spark's default.
READ_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters whose workers cannot import it."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default: too many whole texts for one batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def small_reads(spark: SparkSession) -> None:
    """Let the session's Parquet readers hold fewer rows at once: their arrays of whole texts, grown by doubling, are what fills an executor's heap."""
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":  # Spark's default
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local one is set only where the session names none and runs on one machine (tests); elsewhere its lack is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tessera_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
        spark.sparkContext._tessera_dir = found
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later steps neither repeat its work nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(docs: DataFrame, names) -> DataFrame:
    """The table less the columns whose names (in any case) a result needs for its own."""
    taken = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive texts of about limit characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def row_key(*columns) -> "F.Column":
    """A 64-bit key of a row's id and text, so that rows that share an id but not a text stay apart."""
    return F.xxhash64(*columns)
