"""Plan builders that the operators share: spines, band joins, islands, tap joins, keyed randomness.

Each is a composition of DataFrame operations. A band join is an equi-join on a coarse bucket, so it
shuffles by key and bucket instead of becoming a nested loop.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a literal side that are broadcast: taps, scales, windows given as parameters.
LITERAL_ROWS = 10_000


def literal_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:  # noqa: ANN001
    """A small table of parameters, marked for broadcast when it is within LITERAL_ROWS."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= LITERAL_ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder, for what is read more than once."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="pulseloom-"))
    return df.checkpoint()


def spine(df: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """Each row of ``df`` with each integer from ``start`` up to but not including ``stop``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long"))))


def fill(df: DataFrame, keys: DataFrame, on: Sequence[str], value: str, default: float | int = 0) -> DataFrame:
    """``keys`` with ``value`` from ``df``, ``default`` where it has none."""
    return keys.join(df.select(*on, value), list(on), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, low: int, high: int) -> DataFrame:
    """Pairs of equal ``on`` with ``low <= right_at - left_at <= high`` (integers), as ``left`` columns and
    ``right`` columns (which must not clash but in ``on``). The left side is repeated over at most
    two or three buckets of the band's width."""
    width = max(1, high - low + 1)
    first, last = F.floor((F.col(left_at) + low) / width), F.floor((F.col(left_at) + high) / width)
    a = left.withColumn("__bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    b = right.withColumn("__bucket", F.floor(F.col(right_at) / width).cast("long"))
    return a.join(b, [*on, "__bucket"]).where((F.col(right_at) - F.col(left_at)).between(low, high)).drop("__bucket")


def all_pairs(left: DataFrame, right: DataFrame, i: str, j: str, blocks: int = 16) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, dealt to blocks x blocks by hashes of ``i`` and ``j``: an
    equi-join on the block, for results that are all pairs."""
    a = left.withColumn("__bi", F.pmod(F.xxhash64(i), F.lit(blocks))).withColumn("__bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    b = right.withColumn("__bj", F.pmod(F.xxhash64(j), F.lit(blocks))).withColumn("__bi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return a.join(b, ["__bi", "__bj"]).drop("__bi", "__bj")


def pairs_once(rows: DataFrame, key: str, blocks: int = 16) -> DataFrame:
    """Each pair of rows of different keys once, as (i, j) with i < j and the columns of the aliases ``left`` and
    ``right``, either of which may be i's: blocks meet once, and pairs go to no shuffle."""
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    a = rows.withColumn("__bi", own).withColumn("__bj", F.explode(F.sequence(F.col("__bi"), F.lit(blocks - 1).cast("long"))))
    b = rows.withColumn("__bj", own).withColumn("__bi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__bj"))))
    groups = blocks * (blocks + 1) // 2
    a, b = a.repartition(groups, "__bi", "__bj").alias("left"), b.repartition(groups, "__bi", "__bj").hint("shuffle_hash").alias("right")
    i, j = F.col(f"left.{key}"), F.col(f"right.{key}")
    met = a.join(b, (F.col("left.__bi") == F.col("right.__bi")) & (F.col("left.__bj") == F.col("right.__bj")) & ((F.col("left.__bi") < F.col("left.__bj")) | (i < j)))
    return met.withColumn("i", F.least(i, j)).withColumn("j", F.greatest(i, j))


def islands(df: DataFrame, partition: Sequence[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """``df`` with a running number of runs; ``breaks`` is true where a row starts a new one."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn("__break", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("__break").over(w)).drop("__break")


def tap_join(df: DataFrame, at: str, value: str, taps: DataFrame, keys: Sequence[str], low: int, high: int, out: str) -> DataFrame:
    """Convolution of sparse ``value`` at integer ``at`` with (offset, w) taps, kept within low..high-1."""
    spread = df.crossJoin(taps).withColumn("__to", F.col(at) + F.col("offset")).where(F.col("__to").between(low, high - 1))
    return spread.groupBy(*keys, F.col("__to").alias(at)).agg(F.sum(F.col(value) * F.col("w")).alias(out))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only: reproducible on any cluster."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))
