"""Rates: histograms over trains, kernel-smoothed rates as tap joins, optimal bandwidths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.kernels import Kernel
from pulseloom.operators.binning import Binned
from pulseloom.plans.builders import fill, literal_table, spine, tap_join


def time_histogram(binned: Binned, output: str = "counts", binary: bool = False) -> DataFrame:
    """(bin, value): events of all trains by bin as counts, mean by train, or rate in hertz by train."""
    b = binned.binarized() if binary else binned
    total = b.totals(0)
    if output == "counts":
        return total.select("bin", F.col("n").alias("value"))
    n = F.broadcast(binned.trains.agg(F.count("*").alias("trains")))
    per = total.crossJoin(n).select("bin", (F.col("n") / F.col("trains")).alias("value"))
    if output == "mean":
        return per
    if output == "rate":
        return per.select("bin", (F.col("value") * 1e6 / binned.bin_us).alias("value"))
    raise ValueError(f"output is counts, mean or rate, not {output}")


def instantaneous_rate(
    spikes: DataFrame, trains: DataFrame, period_us: int, kernel: Kernel, t_start_us: int, t_stop_us: int, cutoff: float = 5.0, trim: bool = False, center: bool = True, border_correction: bool = False, pool: bool = False
) -> DataFrame:
    """(train_id, bin, rate_hz): counts on the sampling grid, convolved with the kernel's taps by a tap join.

    ``kernel`` has its sigma in seconds. ``center`` moves a causal kernel's median to zero, ``trim`` keeps only
    the bins that the kernel covers whole, ``border_correction`` divides by its area within the interval,
    ``pool`` averages over trains."""
    n_bins = max(1, (t_stop_us - t_start_us) // period_us)
    inside = spikes.where(F.col("t_us").between(t_start_us, t_stop_us))
    bins = F.least(F.floor((F.col("t_us") - t_start_us) / period_us), F.lit(n_bins - 1)).cast("long")
    counts = inside.select("train_id", bins.alias("bin")).groupBy("train_id", "bin").agg(F.count("*").alias("n"))
    taps = [(k, w) for k, w in kernel.taps(period_us / 1e6, cutoff, center) if w > 0]
    smooth = tap_join(counts, "bin", "n", literal_table(spikes.sparkSession, taps, "offset long, w double"), ["train_id"], 0, n_bins, "rate_hz")
    reach = max(abs(k) for k, _ in taps)
    lo, hi = (min(reach, n_bins), max(0, n_bins - reach)) if trim else (0, n_bins)
    if hi <= lo:
        raise ValueError("the kernel is longer than the interval; trim leaves nothing")
    full = fill(smooth, spine(trains.select("train_id"), "bin", lo, hi), ["train_id", "bin"], "rate_hz", 0.0)
    if border_correction:
        step = period_us / 1e6
        inside_area = [(b, step * sum(w for k, w in taps if 0 <= b - k < n_bins)) for b in range(lo, hi)]
        area = literal_table(spikes.sparkSession, [(b, a) for b, a in inside_area], "bin long, area double")
        full = full.join(area, "bin").select("train_id", "bin", (F.col("rate_hz") / F.nullif("area", F.lit(0.0))).alias("rate_hz"))
    full = full.withColumn("rate_hz", F.greatest("rate_hz", F.lit(0.0)))
    return full.groupBy("bin").agg(F.avg("rate_hz").alias("rate_hz")) if pool else full


def smooth_fft(x: np.ndarray, w: float) -> np.ndarray:
    """Gaussian smoothing with standard deviation ``w`` samples, by the Fourier transform of the padded signal."""
    n = 1 << math.ceil(math.log2(max(2, len(x) + 3 * w)))
    f = np.fft.rfftfreq(n)
    return np.fft.irfft(np.fft.rfft(x, n) * np.exp(-0.5 * (w * 2 * np.pi * f) ** 2), n)[: len(x)]


def bandwidth_cost(counts: np.ndarray, n: int, w: float, dt: float) -> float:
    """The mean squared error of a Gaussian rate estimate up to a constant, times n squared; counts are densities."""
    y = smooth_fft(counts, w / dt)
    return (np.sum(y**2) * dt - 2 * np.sum(y * counts) * dt + 2 / math.sqrt(2 * math.pi) / w / n) * n**2


def _best_bandwidth(times: np.ndarray, grid: list[float] | None) -> tuple[float, float]:
    t = np.sort(times)
    span = t[-1] - t[0]
    gaps = np.diff(t)
    gaps = gaps[gaps > 0]
    dt = max(span / 1000, gaps.min() if len(gaps) else span) if span > 0 else 1.0
    points = int(min(math.ceil(span / dt), 1000)) + 1
    dt = span / max(points - 1, 1) or 1.0
    counts = np.bincount(np.minimum(((t - t[0]) / dt).astype(int), points - 1), minlength=points) / len(t) / dt
    cost = lambda w: bandwidth_cost(counts, len(t), w, dt)
    if grid:
        return min(((w, cost(w)) for w in grid), key=lambda x: x[1])
    lo, hi = math.log(2 * dt), math.log(max(span, 3 * dt))
    phi = (math.sqrt(5) - 1) / 2
    a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
    fa, fb = cost(math.exp(a)), cost(math.exp(b))
    for _ in range(20):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - phi * (hi - lo)
            fa = cost(math.exp(a))
        else:
            lo, a, fa = a, b, fb
            b = lo + phi * (hi - lo)
            fb = cost(math.exp(b))
    return (math.exp(a), fa) if fa < fb else (math.exp(b), fb)


def optimal_bandwidth(spikes: DataFrame, bandwidths: list[float] | None = None) -> DataFrame:
    """(train_id, bandwidth_s, cost): the Gaussian bandwidth of the lowest cost, by golden section or over a grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["t_us"].to_numpy() / 1e6
        w, c = _best_bandwidth(t, bandwidths) if len(t) > 1 else (float("nan"), float("nan"))
        return pd.DataFrame({"train_id": [pdf["train_id"].iloc[0]], "bandwidth_s": [w], "cost": [c]})

    kind = spikes.schema["train_id"].dataType.simpleString()
    return spikes.groupBy("train_id").applyInPandas(run, f"train_id {kind}, bandwidth_s double, cost double")


def soft_exp(x: float) -> float:
    """log(1 + exp(x)): maps all numbers to positive ones, and is x for large x."""
    return math.log1p(math.exp(x)) if x < 100 else x


def soft_log(y: float) -> float:
    """The inverse of ``soft_exp``."""
    return math.log(math.expm1(y)) if y < 100 else y
