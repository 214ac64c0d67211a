"""Sources: how event and vector tables become spike trains, trials and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
DAY_US = 86_400_000_000
SPAN_US = 30 * DAY_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{ORIGIN}', {ts})")


def event_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spikes (train_id, t_us): a train for each user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("train_id"), micros().alias("t_us"))


def unit_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spikes (trial_id, train_id, t_us): a unit for each event type in alphabetical order, a trial for each day."""
    units = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type"))
    t = micros()
    return table(spark, sf_dir, "events").select(F.floor(t / DAY_US).cast("int").alias("trial_id"), F.col("event_type").alias("train_id"), units.cast("int").alias("unit"), F.pmod(t, F.lit(DAY_US)).alias("t_us"))


def trains_of(spikes: DataFrame, t_start_us: int = 0, t_stop_us: int = SPAN_US) -> DataFrame:
    """The trains' dimension: which there are, and their common interval."""
    return spikes.select("train_id").distinct().select("train_id", F.lit(t_start_us).cast("long").alias("t_start_us"), F.lit(t_stop_us).cast("long").alias("t_stop_us"))


def vector_signals(spark: SparkSession, sf_dir: str, channels: int | None = None) -> DataFrame:
    """samples (trial_id, channel, k, v): vector positions are channels, vector ids samples."""
    df = table(spark, sf_dir, "embeddings")
    v = F.col("embedding") if channels is None else F.slice("embedding", 1, channels)
    return df.select(F.col("label").alias("trial_id"), F.col("vec_id").alias("k"), F.posexplode(v).alias("channel", "v")).withColumn("v", F.col("v").cast("double"))


def user_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples (channel, k, v): each user's event values in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("k"), F.col("value").alias("v"))
