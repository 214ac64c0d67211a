"""Sequences of synchronous events: matrices over pairs of bins, kept as rows (i, j, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.unitary import poisson_tail
from pulseloom.plans.builders import band_join


def transactions(cells: DataFrame) -> DataFrame:
    """(bin, ids): which trains are active in each bin."""
    return cells.groupBy("bin").agg(F.sort_array(F.collect_set("train_id")).alias("ids"))


def intersection_matrix(x: DataFrame, y: DataFrame | None = None, norm: str | None = None) -> DataFrame:
    """(i, j, value): trains active in both bins i and j (train_id, bin), divided by the smaller, mean or union size."""
    y = x if y is None else y
    both = x.select("train_id", F.col("bin").alias("i")).distinct().join(y.select("train_id", F.col("bin").alias("j")).distinct(), "train_id").groupBy("i", "j").agg(F.count("*").alias("value"))
    if norm is None:
        return both
    sx = x.groupBy(F.col("bin").alias("i")).agg(F.countDistinct("train_id").alias("a"))
    sy = y.groupBy(F.col("bin").alias("j")).agg(F.countDistinct("train_id").alias("b"))
    by = {"intersection": F.least("a", "b"), "mean": F.sqrt(F.col("a") * F.col("b")), "union": F.col("a") + F.col("b") - F.col("value")}[norm]
    return both.join(sx, "i").join(sy, "j").select("i", "j", (F.col("value") / by).alias("value"))


def probability_matrix(imat: DataFrame, rates: DataFrame) -> DataFrame:
    """(i, j, value): Poisson probability of fewer trains in common than observed, from activity probabilities
    (train_id, bin, p); 0.5 on the diagonal."""
    mean = rates.select("train_id", F.col("bin").alias("i"), F.col("p").alias("pi")).join(rates.select("train_id", F.col("bin").alias("j"), F.col("p").alias("pj")), "train_id")
    mean = mean.join(imat.select("i", "j"), ["i", "j"], "left_semi").groupBy("i", "j").agg(F.sum(F.col("pi") * F.col("pj")).alias("mean"))
    p = 1 - poisson_tail(F.col("value"), F.col("mean"))
    return imat.join(mean, ["i", "j"]).select("i", "j", F.when(F.col("i") == F.col("j"), 0.5).otherwise(p).alias("value"))


def probability_matrix_by_surrogates(imat: DataFrame, surrogate_cells: DataFrame, n_surrogates: int, symmetric: bool = True) -> DataFrame:
    """(i, j, value): share of surrogates (surrogate, train_id, bin) with fewer trains in common than observed in
    ``imat``; 0.5 on the diagonal if ``symmetric``. Only the observed pairs of bins are counted: others have no share."""
    c = surrogate_cells.select("surrogate", "train_id", "bin").distinct()
    drawn = c.withColumnRenamed("bin", "i").join(c.withColumnRenamed("bin", "j"), ["surrogate", "train_id"]).groupBy("surrogate", "i", "j").agg(F.count("*").alias("n"))
    reached = drawn.join(imat, ["i", "j"]).where(F.col("n") >= F.col("value")).groupBy("i", "j").agg(F.count("*").alias("r"))
    share = 1 - F.coalesce("r", F.lit(0)) / n_surrogates
    value = F.when(F.col("i") == F.col("j"), F.lit(0.5)).otherwise(share) if symmetric else share
    return imat.join(reached, ["i", "j"], "left").select("i", "j", value.alias("value"))


def boxcar_rates(cells: DataFrame, trains: DataFrame, n_bins: int, width: int) -> DataFrame:
    """(train_id, bin, p): share of active bins in a window of ``width`` bins; the first and last ``width // 2``
    bins hold the value next to them."""
    half = width // 2
    from pulseloom.plans.builders import spine

    full = spine(trains.select("train_id"), "bin", 0, n_bins).join(cells.select("train_id", "bin").distinct().withColumn("on", F.lit(1)), ["train_id", "bin"], "left")
    w = Window.partitionBy("train_id").orderBy("bin").rowsBetween(-half, (width - 1) // 2)
    rates = full.select("train_id", "bin", (F.sum(F.coalesce("on", F.lit(0))).over(w) / width).alias("p"))
    held = lambda at: F.max(F.when(F.col("bin") == at, F.col("p"))).over(Window.partitionBy("train_id"))
    last = n_bins - 1 - half
    return rates.select("train_id", "bin", F.when(F.col("bin") < half, held(half)).when(F.col("bin") > last, held(last)).otherwise(F.col("p")).alias("p"))


def neighbours(pmat: DataFrame, length: int, width: int, n_largest: int) -> DataFrame:
    """(i, j, value, largest): the largest values in a band of ``length`` along and ``width`` across the diagonal."""
    half, across = length // 2, width // 2
    a = pmat.select("i", "j", "value")
    b = pmat.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("value").alias("v2"))
    near = band_join(a, b, [], "i", "i2", -half, half).where(F.abs((F.col("j2") - F.col("j")) - (F.col("i2") - F.col("i"))) <= across).where(F.abs(F.col("j2") - F.col("j")) <= half)
    return near.groupBy("i", "j", "value").agg(F.slice(F.sort_array(F.collect_list("v2"), asc=False), 1, n_largest).alias("largest"))


def order_survival(u: np.ndarray, n: int) -> float:
    """P that the d largest of n uniform values each reach u (descending): a sum over how many lie in each gap."""
    d = len(u)
    u = np.minimum(np.maximum(u, 0.0), 1 - 1e-9)
    edges = np.concatenate([u[::-1], [1.0]])  # ascending thresholds of the d-th, ..., first largest
    logs = np.log(np.maximum(np.diff(np.concatenate([[0.0], edges])), 1e-300))
    states = {0: 0.0}
    # After the gap above the k-th threshold from the top, at least k values must have been placed.
    for k in range(1, d + 1):
        gap = logs[d - k + 1]
        new: dict[int, list[float]] = {}
        for s, lw in states.items():
            for m in range(n - s + 1):
                if s + m >= k:
                    new.setdefault(s + m, []).append(lw + m * gap - math.lgamma(m + 1))
        states = {s: float(np.logaddexp.reduce(v)) for s, v in new.items()}
    total = [lw + (n - s) * logs[0] - math.lgamma(n - s + 1) for s, lw in states.items()]
    return float(min(1.0, math.exp(np.logaddexp.reduce(total) + math.lgamma(n + 1)))) if total else 0.0


def joint_probability_matrix(pmat: DataFrame, length: int, width: int, n_largest: int) -> DataFrame:
    """(i, j, value): 1 - the joint survival of the largest neighbours. Distinct lists are evaluated once."""
    near = neighbours(pmat, length, width, n_largest).withColumn("key", F.transform("largest", lambda x: F.round(x, 6)))
    n = length * (2 * (width // 2) + 1)

    @F.pandas_udf("double")
    def joint(lists: pd.Series) -> pd.Series:
        return pd.Series([1 - order_survival(np.asarray(x, float), n) for x in lists])

    values = near.select("key").distinct().withColumn("joint", joint("key"))
    return near.join(values, "key").select("i", "j", F.col("joint").alias("value"))


def mask(matrices: list[DataFrame], thresholds: list[float]) -> DataFrame:
    """(i, j) where every matrix is over its threshold."""
    out = None
    for m, t in zip(matrices, thresholds, strict=True):
        over = m.where(F.col("value") > t).select("i", "j")
        out = over if out is None else out.join(over, ["i", "j"])
    return out


def stretched(di: Column, dj: Column, stretch: float) -> Column:
    """Distance that grows by up to ``stretch`` times across the diagonal."""
    alpha = F.when(di == 0, F.lit(math.pi / 2)).otherwise(F.atan(dj / F.nullif(di.cast("double"), F.lit(0.0))))
    d = F.sqrt((di * di + dj * dj).cast("double")) * (1 + (stretch - 1) * F.abs(F.sin(F.lit(math.pi / 4) - alpha)))
    return F.when((di == 0) & (dj == 0), F.lit(0.0)).otherwise(d)


def cluster(pixels: DataFrame, distance: float, least: int, stretch: float) -> DataFrame:
    """(i, j, label): density clusters of pixels by stretched distance; -1 is noise. Core pixels within the distance
    are connected by iterated label spreading; a border pixel joins its smallest neighbouring label."""
    reach = math.ceil(distance)
    a = pixels.select("i", "j")
    near = band_join(a, a.select(F.col("i").alias("i2"), F.col("j").alias("j2")), [], "i", "i2", -reach, reach).where(F.abs(F.col("j2") - F.col("j")) <= reach)
    close = near.where(stretched(F.col("i2") - F.col("i"), F.col("j2") - F.col("j"), stretch) <= distance)
    core = close.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("i", "j")
    links = close.join(core, ["i", "j"]).join(core.select(F.col("i").alias("i2"), F.col("j").alias("j2")), ["i2", "j2"])
    name = lambda i, j: F.concat_ws(":", F.lpad(i.cast("string"), 12, "0"), F.lpad(j.cast("string"), 12, "0"))
    from pulseloom.plans.graphs import components

    comp = components(links.select(name(F.col("i"), F.col("j")).alias("u"), name(F.col("i2"), F.col("j2")).alias("v")), core.select(name(F.col("i"), F.col("j")).alias("node")))
    border = close.withColumn("node", name(F.col("i2"), F.col("j2"))).join(comp, "node").groupBy("i", "j").agg(F.min("component").alias("component"))
    ranked = border.select("component").distinct().withColumn("label", F.row_number().over(Window.orderBy("component")))
    return a.join(border, ["i", "j"], "left").join(ranked, "component", "left").select("i", "j", F.coalesce("label", F.lit(-1)).alias("label"))


def synchronous_events(labels: DataFrame, x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """(label, i, j, ids): trains active in both bins of each cluster's pixels; clusters on the diagonal are left out."""
    y = x if y is None else y
    good = labels.where("label > 0")
    diagonal = good.where("i = j").select("label").distinct()
    good = good.join(diagonal, "label", "left_anti")
    tx, ty = transactions(x).toDF("i", "a"), transactions(y).toDF("j", "b")
    return good.join(tx, "i").join(ty, "j").select("label", "i", "j", F.sort_array(F.array_intersect("a", "b")).alias("ids"))


def sse_combine(a: DataFrame, b: DataFrame, how: str, pixelwise: bool = False) -> DataFrame:
    """Intersection or difference of two sequences (i, j, ids), by link or by whole pixel."""
    other = b.select("i", "j", F.col("ids").alias("other"))
    if pixelwise:
        return a.join(other, ["i", "j"], "left_semi" if how == "intersection" else "left_anti")
    if how == "intersection":
        out = a.join(other, ["i", "j"]).select("i", "j", F.array_intersect("ids", "other").alias("ids"))
    else:
        out = a.join(other, ["i", "j"], "left").select("i", "j", F.array_except("ids", F.coalesce("other", F.array().cast("array<bigint>"))).alias("ids"))
    return out.where(F.size("ids") > 0)


def sse_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (identical, disjoint, contained, contains, overlap) about two sequences."""
    link = lambda s, side: s.select("i", "j", F.explode("ids").alias("id")).distinct().withColumn(side, F.lit(1))
    j = link(a, "x").join(link(b, "y"), ["i", "j", "id"], "full_outer")
    n = j.agg(F.count("x").alias("x"), F.count("y").alias("y"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))
    x, y, both = F.col("x"), F.col("y"), F.col("both")
    same, disjoint = (x == both) & (y == both), (both == 0) & ((x > 0) | (y > 0))
    inside, around = (x == both) & (y > both), (y == both) & (x > both)
    return n.select(same.alias("identical"), disjoint.alias("disjoint"), inside.alias("contained"), around.alias("contains"), (~same & ~disjoint & ~inside & ~around).alias("overlap"))


def sse_units(a: DataFrame) -> DataFrame:
    return a.select(F.explode("ids").alias("id")).distinct()


def sse_bounds(a: DataFrame) -> DataFrame:
    """The first and last bins of a sequence on both axes."""
    return a.agg(F.min("i").alias("i_start"), F.max("i").alias("i_stop"), F.min("j").alias("j_start"), F.max("j").alias("j_stop"))


def is_symmetric(matrix: DataFrame, tolerance: float = 1e-9) -> bool:
    """Whether value (i, j) is value (j, i) everywhere; a missing entry is zero."""
    other = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("mirrored"))
    gap = F.abs(F.coalesce("value", F.lit(0)) - F.coalesce("mirrored", F.lit(0)))
    return matrix.join(other, ["i", "j"], "full").where(gap > tolerance).isEmpty()


def step_values(samples: DataFrame, times: DataFrame, by: str = "channel") -> DataFrame:
    """(by, t_us, v): at each time, the value of the last sample (by, t_us, v) at or before it, or else of the
    first one. One sort of both by time instead of a join."""
    both = samples.select(by, "t_us", "v", F.lit(0).alias("kind")).unionByName(times.select(by, "t_us", F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")))
    w = Window.partitionBy(by).orderBy("t_us", "kind")
    held = F.coalesce(F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return both.withColumn("v", held).where("kind = 1").drop("kind")
