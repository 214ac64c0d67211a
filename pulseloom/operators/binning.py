"""Binning: sparse counts of events by train and bin, never made dense unless asked to.

``Binned.counts`` holds (train_id, bin, n) for non-empty cells; the trains are a table of their own, so
empty trains count. All of it is lazy: slices and views are filters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.plans.builders import fill, spine, uniform


def rounded_bin(t: Column, width: int, tolerance: float | None = 1e-8) -> Column:
    """floor(t / width), one more where t is within ``tolerance`` bins of the next edge."""
    at = F.floor(t / width).cast("long")
    if not tolerance:
        return at
    return at + F.when(F.pmod(t, F.lit(width)) >= width * (1 - tolerance), 1).otherwise(0)


def common_interval(trains: DataFrame) -> tuple[int, int]:
    """The interval that all trains share: the latest start and the earliest stop."""
    start, stop = trains.agg(F.max("t_start_us"), F.min("t_stop_us")).first()
    if start is None or start >= stop:
        raise ValueError("the trains share no interval")
    return int(start), int(stop)


def check_consistency(trains: DataFrame, tolerance_us: int = 0) -> bool:
    """Whether all trains start and stop together, within a tolerance."""
    r = trains.agg(F.max("t_start_us") - F.min("t_start_us"), F.max("t_stop_us") - F.min("t_stop_us")).first()
    return all(x is None or x <= tolerance_us for x in r)


def resolve(trains: DataFrame, bin_us: int | None, n_bins: int | None, t_start_us: int | None, t_stop_us: int | None) -> tuple[int, int, int]:
    """(bin width, bins, start) from what is given, the rest from the trains' common interval."""
    if bin_us is None and n_bins is None:
        raise ValueError("give bin_us or n_bins")
    if t_start_us is None or (t_stop_us is None and (bin_us is None or n_bins is None)):
        start, stop = common_interval(trains)
        t_start_us = start if t_start_us is None else t_start_us
        t_stop_us = stop if t_stop_us is None and (bin_us is None or n_bins is None) else t_stop_us
    if bin_us is None:
        bin_us = (t_stop_us - t_start_us) // n_bins
    if n_bins is None:
        n_bins = (t_stop_us - t_start_us) // bin_us
    if t_stop_us is not None and n_bins != (t_stop_us - t_start_us) // bin_us:
        raise ValueError("bin_us, n_bins and the interval disagree")
    if n_bins < 1:
        raise ValueError("the interval is shorter than a bin")
    return bin_us, n_bins, t_start_us


@dataclass(frozen=True)
class Binned:
    counts: DataFrame
    trains: DataFrame
    bin_us: int
    n_bins: int
    t_start_us: int = 0

    @classmethod
    def of(cls, spikes: DataFrame, trains: DataFrame, bin_us: int | None = None, n_bins: int | None = None, t_start_us: int | None = None, t_stop_us: int | None = None, tolerance: float | None = 1e-8) -> Binned:
        bin_us, n_bins, t0 = resolve(trains, bin_us, n_bins, t_start_us, t_stop_us)
        inside = spikes.where(F.col("t_us").between(t0, t0 + bin_us * n_bins))
        cells = inside.select("train_id", rounded_bin(F.col("t_us") - t0, bin_us, tolerance).alias("bin")).where(F.col("bin") < n_bins)
        return cls(cells.groupBy("train_id", "bin").agg(F.count("*").alias("n")), trains.select("train_id"), bin_us, n_bins, t0)

    @property
    def t_stop_us(self) -> int:
        return self.t_start_us + self.n_bins * self.bin_us

    def edges(self) -> DataFrame:
        one = self.trains.sparkSession.range(0, self.n_bins + 1)
        return one.select(F.col("id").alias("bin"), (F.col("id") * self.bin_us + self.t_start_us).alias("edge_us"))

    def centers(self) -> DataFrame:
        one = self.trains.sparkSession.range(0, self.n_bins)
        return one.select(F.col("id").alias("bin"), (F.col("id") * self.bin_us + self.t_start_us + self.bin_us / 2).alias("center_us"))

    def dense(self) -> DataFrame:
        return fill(self.counts, spine(self.trains, "bin", 0, self.n_bins), ["train_id", "bin"], "n")

    def dense_bool(self) -> DataFrame:
        return self.dense().select("train_id", "bin", (F.col("n") > 0).alias("active"))

    def sparse_bool(self) -> DataFrame:
        return self.counts.select("train_id", "bin", F.lit(True).alias("active"))

    def binarized(self) -> Binned:
        return replace(self, counts=self.counts.select("train_id", "bin", F.lit(1).cast("long").alias("n")))

    def totals(self, axis: int | None = None) -> DataFrame:
        """Events in all (None), by bin (0) or by train (1)."""
        if axis is None:
            return self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        if axis == 0:
            bins = self.trains.sparkSession.range(0, self.n_bins).withColumnRenamed("id", "bin")
            return fill(self.counts.groupBy("bin").agg(F.sum("n").alias("n")), bins, ["bin"], "n")
        return fill(self.counts.groupBy("train_id").agg(F.sum("n").alias("n")), self.trains, ["train_id"], "n")

    def indices(self) -> DataFrame:
        """A row for each event: its train and bin."""
        return self.counts.select("train_id", F.explode(F.array_repeat("bin", F.col("n").cast("int"))).alias("bin"))

    def is_binary(self) -> DataFrame:
        return self.counts.agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("is_binary"))

    def sparsity(self) -> DataFrame:
        cells = self.trains.agg((F.count("*") * self.n_bins).alias("cells"))
        return self.counts.agg(F.count("*").alias("filled")).crossJoin(F.broadcast(cells)).select((F.col("filled") / F.col("cells")).alias("sparsity"))

    def time_slice(self, t_start_us: int | None = None, t_stop_us: int | None = None) -> Binned:
        """Bins from the first that starts at or after ``t_start_us`` to the one that ends by ``t_stop_us``."""
        lo = 0 if t_start_us is None else max(0, -(-(t_start_us - self.t_start_us) // self.bin_us))
        hi = self.n_bins if t_stop_us is None else min(self.n_bins, (t_stop_us - self.t_start_us) // self.bin_us)
        return self.take(lo, hi)

    def take(self, start: int, stop: int, step: int = 1, trains: list | None = None) -> Binned:
        """Bins start, start + step, ... below stop, of some trains; every step-th bin becomes as wide as step bins."""
        kept = self.counts.where((F.col("bin") >= start) & (F.col("bin") < stop) & (F.pmod(F.col("bin") - start, F.lit(step)) == 0))
        rows = self.trains
        if trains is not None:
            kept, rows = kept.where(F.col("train_id").isin(trains)), rows.where(F.col("train_id").isin(trains))
        moved = kept.select("train_id", F.floor((F.col("bin") - start) / step).cast("long").alias("bin"), "n")
        return Binned(moved, rows, self.bin_us * step, -(-(stop - start) // step), self.t_start_us + start * self.bin_us)

    def with_cells(self, cells: DataFrame) -> Binned:
        """Some cells (train_id, bin, n) set anew; zeros are taken out."""
        joined = self.counts.join(cells.withColumnRenamed("n", "new"), ["train_id", "bin"], "full_outer")
        return replace(self, counts=joined.select("train_id", "bin", F.coalesce("new", "n").alias("n")).where("n <> 0"))

    def equals(self, other: Binned) -> bool:
        if (self.bin_us, self.n_bins, self.t_start_us) != (other.bin_us, other.n_bins, other.t_start_us):
            return False
        a, b = self.counts.select("train_id", "bin", "n"), other.counts.select("train_id", "bin", "n")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def rescaled(self, factor: int) -> Binned:
        """The same bins in units ``factor`` times as fine."""
        return replace(self, bin_us=self.bin_us * factor, t_start_us=self.t_start_us * factor)

    def to_spikes(self, place: str = "random", seed: int = 0) -> DataFrame:
        """Events within their bins: n at k / n ("left"), at (k + 1) / (n + 1) ("center"), or drawn ("random")."""
        each = self.counts.select("train_id", "bin", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        where = {
            "left": F.col("k") / F.col("n"), "center": (F.col("k") + 1) / (F.col("n") + 1), "random": uniform(seed, F.col("train_id"), F.col("bin"), F.col("k")),
        }[place]
        return each.select("train_id", "bin", (F.col("bin") * self.bin_us + self.t_start_us + F.floor(where * self.bin_us)).cast("long").alias("t_us"))


def binarize(spikes: DataFrame, trains: DataFrame, period_us: int, t_start_us: int, t_stop_us: int) -> DataFrame:
    """Whether a train has an event next to each sample of a grid; bins are centred on the samples."""
    n = (t_stop_us - t_start_us) // period_us + 1
    hit = spikes.where(F.col("t_us").between(t_start_us, t_stop_us)).select("train_id", F.least(F.floor((F.col("t_us") - t_start_us) / period_us + 0.5), F.lit(n - 1)).cast("long").alias("k")).distinct()
    return spine(trains.select("train_id"), "k", 0, n).join(hit.withColumn("hit", F.lit(True)), ["train_id", "k"], "left").select("train_id", "k", F.coalesce("hit", F.lit(False)).alias("active"))


def discretise(spikes: DataFrame, period_us: int, t_start_us: int = 0) -> DataFrame:
    """Times moved down to the sampling grid, not before the start."""
    return spikes.withColumn("t_us", F.greatest(F.floor(F.col("t_us") / period_us) * period_us, F.lit(t_start_us)).cast("long"))
