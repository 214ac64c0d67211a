"""Shared helpers of the text operators: shared storage, Arrow plumbing, hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Stands for a null key where an integer is needed.
NULL_ID = -(1 << 63)

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's reader only (any file system works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one on a single machine (tests).

    Raises on a cluster without that setting: its machines share no other folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulseloom-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write to a table in the shared checkpoint folder and read it back: compact, and safe from lost executors.

    The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pulseloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    if len(_STORED) == 1:
        atexit.register(_drop_stored, spark)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def _drop_stored(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _STORED:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc, text) of the rows of ``df``: doc is a long that orders documents, null texts are empty.

    A document is a key and a text. Where every key has one text, doc is the key (NULL_ID where it is null). Where
    a key has several, all are numbered in the order of their keys and then of a hash of their texts."""
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = docs.select("doc", F.xxhash64("text").alias("mark"))
    if marked.groupBy("doc").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").isEmpty():
        return docs
    # Numbers rise with the partitions of a sorted table, which are ranges.
    ranks = store(marked.distinct().orderBy("doc", "mark").withColumn("rank", F.monotonically_increasing_id()))
    return docs.withColumn("mark", F.xxhash64("text")).join(ranks, ["doc", "mark"]).select("key", F.col("rank").alias("doc"), "text")


def scratch_name(tag: str) -> str:
    """A column name that no input column has."""
    return f"__{tag}_{uuid.uuid4().hex[:8]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows and bytes of a batch that goes to a worker: texts may be long, and a batch is held about three times on both sides.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 20


def small_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """``df``; from now on its session sends texts to workers in batches of at most ``rows`` rows that
    end with the row that reaches ``size`` bytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if now <= 0 or now > rows:
        conf.set(name, str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow keeps of a batch's memory goes back to the system once it has been dealt with."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None]) -> None:
    """Called in a worker before it fills memos: what other operators hold there is released first."""
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
    _HELD[owner] = release


class BoundedMemo(dict):
    """A dictionary that computes what it misses, in two generations of ``limit // 2`` entries.

    Once the younger one is full it becomes the older, whose entries move back when they are asked for
    again: what is frequent stays, what is rare goes."""

    def __init__(self, compute: Callable, limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.older = compute, max(1, limit // 2), {}

    def clear(self) -> None:
        super().clear()
        self.older = {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            super().clear()
        self[key] = value
        return value
