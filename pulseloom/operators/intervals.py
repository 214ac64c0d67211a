"""Interval statistics: a sort by train, one lag, then a hash aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def isi(spikes: DataFrame, by: str = "train_id") -> DataFrame:
    """(by, i, isi_us): differences of neighbouring events."""
    w = Window.partitionBy(by).orderBy("t_us")
    gaps = spikes.select(by, "t_us", (F.row_number().over(w) - 2).alias("i"), (F.col("t_us") - F.lag("t_us").over(w)).alias("isi_us"))
    return gaps.where(F.col("isi_us").isNotNull()).select(by, F.col("i").cast("long").alias("i"), "isi_us")


def mean_firing_rate(spikes: DataFrame, trains: DataFrame, t_start_us: int | None = None, t_stop_us: int | None = None) -> DataFrame:
    """(train_id, rate_hz): events within the closed interval, by its length; whole trains by default."""
    lo = F.col("t_start_us") if t_start_us is None else F.lit(t_start_us)
    hi = F.col("t_stop_us") if t_stop_us is None else F.lit(t_stop_us)
    joined = trains.join(spikes, "train_id", "left").withColumn("lo", lo).withColumn("hi", hi)
    hit = F.count_if(F.col("t_us").between(F.col("lo"), F.col("hi")))
    return joined.groupBy("train_id").agg((hit * 1e6 / (F.first("hi") - F.first("lo"))).alias("rate_hz"))


def fanofactor(counts: DataFrame, by: list[str]) -> DataFrame:
    """Variance by mean of the event counts ``n`` (rows for empty trains included), null if all are zero."""
    return counts.groupBy(*by).agg((F.var_pop("n") / F.nullif(F.avg("n"), F.lit(0.0))).alias("fano"))


def cv(intervals: DataFrame, by: str = "train_id") -> DataFrame:
    """Coefficient of variation of the intervals."""
    return intervals.groupBy(by).agg((F.stddev_pop("isi_us") / F.avg("isi_us")).alias("cv"))


def _pairs(intervals: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy("i")
    return intervals.withColumn("next_us", F.lead("isi_us").over(w)).where(F.col("next_us").isNotNull())


def local_variation(intervals: DataFrame, by: str = "train_id", refractory_us: int = 5_000) -> DataFrame:
    """(by, cv2, lv, lvr) from each pair of neighbouring intervals; trains with fewer than two have no row."""
    a, b = F.col("isi_us").cast("double"), F.col("next_us").cast("double")
    total = F.nullif(a + b, F.lit(0.0))
    return _pairs(intervals, by).groupBy(by).agg(
        (2 * F.avg(F.abs(a - b) / total)).alias("cv2"),
        (3 * F.avg(F.pow((a - b) / total, 2))).alias("lv"),
        (3 * F.avg((1 - 4 * a * b / (total * total)) * (1 + 4 * refractory_us / total))).alias("lvr"),
    )
