"""Surrogates: trains with randomness that depends on the seed, the surrogate and the event only.

Most are projections or one sort by train. Those in which an event's move depends on the moves before it
(a dead time, joint intervals, sliding windows) run a train's surrogate as one group, whose generator is
seeded by the same keys. So all are the same on any cluster and after lost tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.plans.builders import uniform

METHODS = ("dither_spikes", "randomise_spikes", "shuffle_isis", "dither_spike_train", "jitter_spikes", "bin_shuffling", "trial_shifting", "joint_isi_dithering", "isi_dithering")


def _copies(spikes: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("train_id").orderBy("t_us")
    return spikes.select("train_id", "t_us", F.row_number().over(w).alias("i")).withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _moved(df: DataFrame, t, lo: int, hi: int, edges: bool) -> DataFrame:  # noqa: ANN001
    df = df.withColumn("t_us", t.cast("long"))
    df = df.where((F.col("t_us") > lo) & (F.col("t_us") < hi)) if edges else df.withColumn("t_us", F.greatest(F.least("t_us", F.lit(hi)), F.lit(lo)))
    return df.select("surrogate", "train_id", "t_us")


def dither_spikes(spikes: DataFrame, dither_us: int, t_start_us: int, t_stop_us: int, n: int = 1, edges: bool = True, seed: int = 0) -> DataFrame:
    """Each event moved by up to ``dither_us`` either way; what leaves the open interval is dropped, or clipped without ``edges``."""
    u = uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("i"))
    return _moved(_copies(spikes, n), F.col("t_us") + F.floor((2 * u - 1) * dither_us), t_start_us, t_stop_us, edges)


def _by_train(df: DataFrame, n: int, seed: int, move: Callable[[pd.DataFrame, np.random.Generator], pd.DataFrame], schema: str) -> DataFrame:
    """``move`` applied to each train of each surrogate, with a generator that their numbers seed."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = move(group, np.random.default_rng([seed, int(key[0]), *str(key[1]).encode()]))
        out.insert(0, "surrogate", key[0])
        out.insert(1, "train_id", key[1])
        return out

    kind = df.schema["train_id"].dataType.simpleString()
    each = df.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.groupBy("surrogate", "train_id").applyInPandas(run, f"surrogate int, train_id {kind}, {schema}")


def dither_refractory(spikes: DataFrame, dither_us: int, refractory_us: int, t_start_us: int, t_stop_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """Each event, in random order, moved uniformly within ``dither_us`` either way, but no nearer to its
    neighbours' present places than the dead time (or the train's shortest interval, if that is less), nor outside the train."""

    def move(group: pd.DataFrame, rng: np.random.Generator) -> pd.DataFrame:
        t = np.sort(group["t_us"].to_numpy()).astype(float)
        dead = min([float(refractory_us), *np.diff(t)])
        # Sentinels a dead time outside, so that the first and last event can reach the edges.
        x = np.concatenate([[t_start_us - dead], t, [t_stop_us + dead]])
        for k, u in zip(rng.permutation(len(t)) + 1, rng.random(len(t)), strict=True):
            left, right = min(dither_us, x[k] - x[k - 1] - dead), min(dither_us, x[k + 1] - x[k] - dead)
            x[k] = min(max(math.floor(x[k] - left + u * (left + right)), x[k] - left), x[k] + right)
        return pd.DataFrame({"t_us": x[1:-1].astype(np.int64)})

    return _by_train(spikes.select("train_id", "t_us"), n, seed, move, "t_us long")


def randomise_spikes(spikes: DataFrame, t_start_us: int, t_stop_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """As many events at uniform times."""
    u = uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("i"))
    return _copies(spikes, n).select("surrogate", "train_id", (t_start_us + F.floor(u * (t_stop_us - t_start_us))).cast("long").alias("t_us"))


def shuffle_isis(spikes: DataFrame, t_start_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """The intervals, the first one's from the start included, in another order."""
    by = Window.partitionBy("surrogate", "train_id")
    gap = F.col("t_us") - F.coalesce(F.lag("t_us").over(by.orderBy("i")), F.lit(t_start_us))
    u = uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("i"))
    drawn = _copies(spikes, n).select("surrogate", "train_id", "i", gap.alias("gap"), u.alias("u"))
    return drawn.select("surrogate", "train_id", (F.sum("gap").over(by.orderBy("u", "i")) + t_start_us).cast("long").alias("t_us"))


def dither_train(spikes: DataFrame, shift_us: int, t_start_us: int, t_stop_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """All events of a train moved by one shift; those within [start, stop) stay."""
    u = uniform(seed, F.col("surrogate"), F.col("train_id"))
    moved = _copies(spikes, n).withColumn("t_us", (F.col("t_us") + F.floor((2 * u - 1) * shift_us)).cast("long"))
    return moved.where((F.col("t_us") >= t_start_us) & (F.col("t_us") < t_stop_us)).select("surrogate", "train_id", "t_us")


def jitter_spikes(spikes: DataFrame, bin_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """Each event drawn anew within its bin."""
    u = uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("i"))
    return _copies(spikes, n).select("surrogate", "train_id", (F.floor(F.col("t_us") / bin_us) * bin_us + F.floor(u * bin_us)).cast("long").alias("t_us"))


def bin_shuffling(counts: DataFrame, window: int, n: int = 1, seed: int = 0) -> DataFrame:
    """(surrogate, train_id, bin, n): bins permuted within windows of ``window`` bins, counts and all."""
    full = counts.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("window", F.floor(F.col("bin") / window).cast("long"))
    # The k-th of a window's bins in the order of their draws; only filled bins need a place.
    places = full.select("surrogate", "train_id", "window").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    by = Window.partitionBy("surrogate", "train_id", "window")
    places = places.withColumn("rank", F.row_number().over(by.orderBy(uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("window"), F.col("slot")), "slot")))
    ranked = full.withColumn("rank", F.row_number().over(by.orderBy("bin")))
    return ranked.join(places, ["surrogate", "train_id", "window", "rank"]).select("surrogate", "train_id", (F.col("window") * window + F.col("slot")).alias("bin"), "n")


def bin_shuffling_continuous(spikes: DataFrame, bin_us: int, window: int, t_start_us: int, t_stop_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """(surrogate, train_id, t_us): bins permuted within windows of ``window`` bins, and each event drawn anew
    within its new bin; what leaves the open interval is dropped."""
    at = F.floor((F.col("t_us") - t_start_us) / bin_us).cast("long")
    u = uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("i"))
    events = _copies(spikes, n).select("surrogate", "train_id", F.floor(at / window).cast("long").alias("window"), F.pmod(at, F.lit(window)).alias("slot"), u.alias("u"))
    by = Window.partitionBy("surrogate", "train_id", "window")
    draw = uniform(seed, F.col("surrogate"), F.col("train_id"), F.col("window"), F.col("slot"))
    places = events.select("surrogate", "train_id", "window").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(window - 1).cast("long"))))
    places = places.withColumn("to", F.row_number().over(by.orderBy(draw, "slot")) - 1)
    moved = events.join(places, ["surrogate", "train_id", "window", "slot"])
    return _moved(moved, t_start_us + (F.col("window") * window + F.col("to")) * bin_us + F.floor(F.col("u") * bin_us), t_start_us, t_stop_us, True)


def bin_shuffling_sliding(counts: DataFrame, window: int, n_bins: int, n: int = 1, seed: int = 0) -> DataFrame:
    """(surrogate, train_id, bin): filled bins after a window of ``window`` bins has moved over the train bin by
    bin, from the first to the last but one place, shuffling what it holds at each stop.

    Only whether a window's bins are filled matters, so a stop without filled bins is skipped, and
    the filled ones of the others are dealt to random places."""

    def move(group: pd.DataFrame, rng: np.random.Generator) -> pd.DataFrame:
        full = np.zeros(n_bins, bool)
        full[group["bin"].to_numpy()] = True
        for a in range(n_bins - window):
            if k := int(full[a : a + window].sum()):
                full[a : a + window] = False
                full[a + rng.choice(window, k, replace=False)] = True
        return pd.DataFrame({"bin": np.flatnonzero(full).astype(np.int64)})

    return _by_train(counts.where("n > 0").select("train_id", "bin"), n, seed, move, "bin long")


def trial_shifting(spikes: DataFrame, dither_us: int, length_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """(surrogate, trial_id, train_id, t_us): each trial of a train shifted in a circle of ``length_us``."""
    each = spikes.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = uniform(seed, F.col("surrogate"), F.col("trial_id"), F.col("train_id"))
    return each.select("surrogate", "trial_id", "train_id", F.pmod(F.col("t_us") + F.floor((2 * u - 1) * dither_us), F.lit(length_us)).cast("long").alias("t_us"))


def shift_trials_of_one(spikes: DataFrame, dither_us: int, trial_us: int, gap_us: int, t_start_us: int, t_stop_us: int, n: int = 1, seed: int = 0) -> DataFrame:
    """(surrogate, train_id, t_us): trials of ``trial_us`` that follow each other at gaps of ``gap_us`` within a train,
    each shifted in its circle; events in gaps, or after the last whole trial and gap, have no trial and are left out."""
    period = trial_us + gap_us
    n_trials = (t_stop_us - t_start_us) // period
    trial, within = F.floor((F.col("t_us") - t_start_us) / period).cast("long"), F.pmod(F.col("t_us") - t_start_us, F.lit(period))
    cut_up = spikes.select("train_id", trial.alias("trial_id"), within.alias("t_us")).where((F.col("trial_id") < n_trials) & (F.col("trial_id") >= 0) & (F.col("t_us") <= trial_us))
    moved = trial_shifting(cut_up, dither_us, trial_us, n, seed)
    return moved.select("surrogate", "train_id", (F.col("t_us") + F.col("trial_id") * period + t_start_us).alias("t_us"))


def smoothed(table: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of both axes; the edges are mirrored, and the taps end at four sigma."""
    if sigma <= 0 or not table.size:
        return table
    r = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        wide = np.pad(table, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        table = np.apply_along_axis(np.convolve, axis, wide, taps, "valid")
    return table


#: Trains with fewer events have no pair of intervals to speak of; their surrogates are the trains.
LEAST_EVENTS = 3


def joint_isi_density(gaps: np.ndarray, limit: float, n_bins: int, sigma: float, dead: float, independent: bool = False, root: bool = False, cutoff: bool = True) -> np.ndarray:
    """Smoothed counts of neighbouring intervals by bins, up to ``limit``; ``independent``: of any two intervals.
    With ``cutoff`` nothing is smoothed into, or kept in, the bins below the dead time's."""
    span = (0.0, limit)
    if independent:
        one = np.histogram(gaps, n_bins, span)[0].astype(float)
        table = np.outer(one, one)
    else:
        table = np.histogram2d(gaps[:-1], gaps[1:], n_bins, [span, span])[0]
    if root:
        table = np.sqrt(table)
    if sigma > 0:
        first = min(int(dead * n_bins // limit), n_bins) if cutoff else 0
        inner = smoothed(table[first:, first:], sigma * n_bins / limit)
        table = np.zeros_like(table)
        table[first:, first:] = inner
    return table


def joint_isi_dithering(
    spikes: DataFrame, dither_us: int = 15_000, t_stop_us: int | None = None, limit_us: int = 100_000, n_bins: int = 100, sigma_us: int = 2_000, refractory_us: int = 4_000,
    alternate: bool = True, root: bool = False, window: bool = True, cutoff: bool = True, independent: bool = False, n: int = 1, seed: int = 0,
) -> DataFrame:
    """(surrogate, train_id, t_us): events moved by steps drawn from the train's joint density of the intervals
    before and after them, on the line where their sum stays (within ``dither_us`` with ``window``). With
    ``alternate`` first every other event is moved, then the rest. Pairs that the density has nothing for
    are moved uniformly, up to the dead time. The first and last event stay."""
    width = limit_us / n_bins
    reach = int(dither_us // width) if window else n_bins

    def move(group: pd.DataFrame, rng: np.random.Generator) -> pd.DataFrame:
        t = np.sort(group["t_us"].to_numpy())
        if len(t) < LEAST_EVENTS:
            return pd.DataFrame({"t_us": t})
        gaps = np.diff(t).astype(float)
        dead = min(float(refractory_us), gaps.min())
        table = joint_isi_density(gaps, limit_us, n_bins, sigma_us, dead, independent, root, cutoff)
        # totals[s, k]: what the line of sum s holds in its first k cells.
        totals = np.zeros((n_bins, n_bins + 1))
        for s in range(n_bins):
            totals[s, 1 : s + 2] = np.cumsum(table[np.arange(s + 1), s - np.arange(s + 1)])
        draws = rng.random(len(gaps))
        for first in range(2 if alternate else 1):
            cells = (gaps // width).astype(np.int64)
            for k in range(first, len(gaps) - 1, 2 if alternate else 1):
                a, s = int(cells[k]), int(cells[k] + cells[k + 1])
                step = None
                if s < n_bins:
                    lo, hi = (max(0, a - reach + 1), min(s, a + reach) + 1) if window else (0, s + 1)
                    part = totals[s, lo : hi + 1]
                    if hi > lo and part[-1] > part[0]:
                        to = lo + int(np.searchsorted(part, part[0] + draws[k] * (part[-1] - part[0]), "left")) - 1
                        step = (max(lo, to) - a) * width
                if step is None:
                    left, right = min(gaps[k] - dead, dither_us), min(gaps[k + 1] - dead, dither_us)
                    step = draws[k] * (left + right) - left
                gaps[k] += step
                gaps[k + 1] -= step
        moved = t[0] + np.concatenate([[0], np.rint(np.cumsum(gaps)).astype(np.int64)])
        return pd.DataFrame({"t_us": moved if t_stop_us is None else np.minimum(moved, t_stop_us)})

    return _by_train(spikes.select("train_id", "t_us"), n, seed, move, "t_us long")


def joint_isi_histogram(spikes: DataFrame, bin_us: int, n_bins: int = 100) -> DataFrame:
    """(a, b, n): pairs of neighbouring intervals by bins, those over the limit left out."""
    from pulseloom.operators.intervals import isi

    w = Window.partitionBy("train_id").orderBy("i")
    pairs = isi(spikes).select("isi_us", F.lead("isi_us").over(w).alias("next_us")).where(F.col("next_us").isNotNull())
    bins = pairs.select(F.floor(F.col("isi_us") / bin_us).cast("long").alias("a"), F.floor(F.col("next_us") / bin_us).cast("long").alias("b"))
    return bins.where((F.col("a") < n_bins) & (F.col("b") < n_bins)).groupBy("a", "b").agg(F.count("*").alias("n"))


def surrogates(spikes: DataFrame, method: str, n: int = 1, dt_us: int | None = None, t_start_us: int = 0, t_stop_us: int = 0, seed: int = 0, bin_us: int = 1_000, trial_us: int | None = None, gap_us: int = 0) -> DataFrame:
    """(surrogate, train_id, t_us) by the method's name.

    Bin shuffling moves bins of ``bin_us`` within windows of ``dt_us``. Trial shifting takes trials from a
    ``trial_id`` column, or cuts trains into trials of ``trial_us`` (the whole interval unless given)."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if dt_us is None and method not in ("randomise_spikes", "shuffle_isis"):
        raise ValueError(f"{method} needs dt_us")
    return {
        "dither_spikes": lambda: dither_spikes(spikes, dt_us, t_start_us, t_stop_us, n, True, seed),
        "randomise_spikes": lambda: randomise_spikes(spikes, t_start_us, t_stop_us, n, seed),
        "shuffle_isis": lambda: shuffle_isis(spikes, t_start_us, n, seed),
        "dither_spike_train": lambda: dither_train(spikes, dt_us, t_start_us, t_stop_us, n, seed),
        "jitter_spikes": lambda: jitter_spikes(spikes, dt_us, n, seed),
        "bin_shuffling": lambda: bin_shuffling_continuous(spikes, bin_us, max(1, dt_us // bin_us), t_start_us, t_stop_us, n, seed),
        "trial_shifting": lambda: trial_shifting(spikes, dt_us, t_stop_us - t_start_us, n, seed) if "trial_id" in spikes.columns else shift_trials_of_one(spikes, dt_us, trial_us or t_stop_us - t_start_us, gap_us, t_start_us, t_stop_us, n, seed),
        "joint_isi_dithering": lambda: joint_isi_dithering(spikes, dt_us, t_stop_us, n=n, seed=seed),
        "isi_dithering": lambda: joint_isi_dithering(spikes, dt_us, t_stop_us, independent=True, n=n, seed=seed),
    }[method]()
