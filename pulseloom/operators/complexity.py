"""Complexity and synchrony: histograms of how many trains are active together, epochs, synchronous events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.binning import Binned
from pulseloom.plans.builders import literal_table


def time_complexity(binned: Binned, binary: bool = True) -> DataFrame:
    """(bin, complexity) of non-empty bins."""
    b = binned.binarized() if binary else binned
    return b.counts.groupBy("bin").agg(F.sum("n").alias("complexity"))


def epochs(binned: Binned, binary: bool = True, spread: int = 0) -> DataFrame:
    """(epoch, first_bin, last_bin, complexity): runs of active bins whose gaps are at most ``spread`` bins;
    each active bin is its own epoch without spread.

    The sum over bins is small (one row a bin), and it alone is put in order."""
    active = time_complexity(binned, binary)
    if spread == 0:
        return active.select(F.col("bin").alias("epoch"), F.col("bin").alias("first_bin"), F.col("bin").alias("last_bin"), "complexity")
    w = Window.orderBy("bin")
    new = F.coalesce(F.col("bin") - F.lag("bin").over(w) > spread, F.lit(True))
    runs = active.withColumn("new", new.cast("int")).withColumn("epoch", F.sum("new").over(w))
    return runs.groupBy("epoch").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("complexity").alias("complexity"))


def complexity_histogram(binned: Binned, binary: bool = True, spread: int = 0) -> DataFrame:
    """(complexity, n): epochs of each complexity; for 0, the bins outside all epochs."""
    e = epochs(binned, binary, spread)
    some = e.groupBy("complexity").agg(F.count("*").alias("n"))
    used = e.agg(F.coalesce(F.sum(F.col("last_bin") - F.col("first_bin") + 1), F.lit(0)).alias("used"))
    none = used.select(F.lit(0).cast("long").alias("complexity"), (F.lit(binned.n_bins) - F.col("used")).alias("n"))
    return none.unionByName(some)


def complexity_pdf(binned: Binned, binary: bool = True, spread: int = 0) -> DataFrame:
    h = complexity_histogram(binned, binary, spread)
    total = F.broadcast(h.agg(F.sum("n").alias("total")))
    return h.crossJoin(total).select("complexity", (F.col("n") / F.col("total")).alias("p"))


def annotate_synchrony(spikes: DataFrame, binned: Binned, spread: int = 0, tolerance: float = 1e-8) -> DataFrame:
    """``spikes`` with the complexity of the epoch that each lies in, by an equi-join on its bin."""
    from pulseloom.operators.binning import rounded_bin

    e = epochs(binned, True, spread)
    by_bin = e.select(F.explode(F.sequence("first_bin", "last_bin")).alias("bin"), "complexity")
    return spikes.withColumn("bin", rounded_bin(F.col("t_us") - binned.t_start_us, binned.bin_us, tolerance)).join(by_bin, "bin").drop("bin")


def delete_synchrony(annotated: DataFrame, threshold: int, mode: str = "delete") -> DataFrame:
    """Events of lower complexity ("delete"), or of the threshold and more ("extract")."""
    if threshold <= 1:
        raise ValueError("the threshold must be over 1")
    if mode not in ("delete", "extract"):
        raise ValueError("mode is delete or extract")
    return annotated.where(F.col("complexity") < threshold if mode == "delete" else F.col("complexity") >= threshold)


def scales(duration_us: int, least_us: int, shrink: float = 0.9) -> list[int]:
    """Bin widths from half the duration down, each ``shrink`` times the last."""
    out, width = [], duration_us / 2
    while width >= least_us:
        out.append(int(width) // 2 * 2)
        width *= shrink
    return out


def least_interval(spikes: DataFrame) -> DataFrame:
    """One row: the least interval between events of one train, 0 where no train has two."""
    gap = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("train_id").orderBy("t_us"))
    return spikes.select(gap.alias("gap")).agg(F.coalesce(F.min("gap"), F.lit(0)).cast("long").alias("least"))


def spike_contrast(spikes: DataFrame, n_trains: int, duration_us: int, widths: list[int]) -> DataFrame:
    """(width_us, contrast, active, synchrony) by scale; the trains' synchrony is the largest (``synchrony``).

    Bins overlap by half: an event counts in the two bins over its half step, in the interval widened on
    both sides by the least interval between a train's events. Contrast is the sum of differences of neighbouring
    counts by twice the events. All scales are one plan; counts are summed by train before trains are counted."""
    w = literal_table(spikes.sparkSession, [(x,) for x in widths], "width_us long")
    inside = spikes.where(F.col("t_us").between(0, duration_us))
    total = F.broadcast(inside.agg(F.count("*").alias("events")).crossJoin(least_interval(inside)))
    half = F.col("width_us") / 2
    span = F.ceil((F.lit(duration_us) + 2 * F.col("least")) / half).cast("long")
    each = inside.crossJoin(w).crossJoin(total).select("train_id", "width_us", "events", (span - 2).alias("last"), F.least(F.floor((F.col("t_us") + F.col("least")) / half).cast("long"), span - 1).alias("step"))
    steps = each.groupBy("width_us", "events", "last", "step", "train_id").agg(F.count("*").alias("k"))
    by_bin = steps.withColumn("bin", F.explode(F.array(F.col("step") - 1, F.col("step")))).where((F.col("bin") >= 0) & (F.col("bin") <= F.col("last")))
    by_train = by_bin.groupBy("width_us", "events", "last", "bin", "train_id").agg(F.sum("k").alias("k"))
    bins = by_train.groupBy("width_us", "events", "last", "bin").agg(F.sum("k").alias("theta"), F.count("*").alias("n"))
    order = Window.partitionBy("width_us").orderBy("bin")
    # The sum of differences of neighbours; empty bins are zero, so a gap costs what is before and after it.
    before, at = F.lag("theta").over(order), F.lag("bin").over(order)
    jump = F.when(at == F.col("bin") - 1, F.abs(F.col("theta") - before)).otherwise(F.col("theta") + F.coalesce(before, F.lit(0)))
    edge_first = F.when(at.isNull() & (F.col("bin") == 0), 0).otherwise(jump)
    edge_last = F.when(F.lead("bin").over(order).isNull() & (F.col("bin") < F.col("last")), F.col("theta")).otherwise(0)
    jumps = bins.withColumn("jump", edge_first + edge_last)
    per = jumps.groupBy("width_us", "events").agg(F.sum("jump").alias("jumps"), F.sum("theta").alias("total"), F.sum(F.col("n") * F.col("theta")).alias("weighted"))
    contrast = F.col("jumps") / (2 * F.col("events"))
    active = (F.col("weighted") / F.col("total") - 1) / (n_trains - 1)
    return per.select("width_us", contrast.alias("contrast"), active.alias("active"), (contrast * active).alias("synchrony"))


def synchrony(trace: DataFrame) -> DataFrame:
    """One row: the largest synchrony of all scales."""
    return trace.agg(F.max("synchrony").alias("synchrony"))
