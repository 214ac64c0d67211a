"""Signals: samples (channel, k, v) as rows; windows and index joins, numpy only where a filter is sequential."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.plans.builders import band_join, islands


def zscore(samples: DataFrame, by: str = "channel") -> DataFrame:
    """(v - mean) / standard deviation by channel, 0 where a channel is constant. Moments are aggregated, not windowed."""
    m = samples.groupBy(by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).otherwise(0.0)
    return samples.join(m, by).select(*[c for c in samples.columns if c != "v"], z.alias("v"))


def cross_correlation(samples: DataFrame, pairs: list[tuple], max_lag: int, scale: str = "unbiased") -> DataFrame:
    """(i, j, lag, value) of z-scored channel pairs: mean products of i at t and j at t + lag."""
    z = zscore(samples)
    x = z.select(F.col("channel").alias("i"), F.col("k").alias("ki"), F.col("v").alias("vi"))
    y = z.select(F.col("channel").alias("j"), F.col("k").alias("kj"), F.col("v").alias("vj"))
    wanted = F.broadcast(samples.sparkSession.createDataFrame([tuple(p) for p in pairs], "i int, j int")).withColumn("pair", F.concat_ws(":", "i", "j"))
    a, b = x.join(wanted, "i").select("pair", "i", "ki", "vi"), y.join(wanted, "j").select("pair", "j", "kj", "vj")
    joined = band_join(a, b, ["pair"], "ki", "kj", -max_lag, max_lag).groupBy("i", "j", (F.col("kj") - F.col("ki")).alias("lag")).agg(F.sum(F.col("vi") * F.col("vj")).alias("s"))
    n = F.broadcast(samples.groupBy("channel").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")))
    by = {"biased": F.col("n"), "unbiased": F.col("n") - F.abs("lag"), "none": F.lit(1)}[scale]
    return joined.crossJoin(n).select("i", "j", "lag", (F.col("s") / by).alias("value"))


def rauc(samples: DataFrame, baseline: str | float | None = None, bin_samples: int | None = None, fs: float = 1.0) -> DataFrame:
    """(channel, bin, area): trapezoid of |v - baseline| within each bin; trapezoids do not bridge bins, and a last
    bin that is not full goes on with zeros."""
    if baseline in ("mean", "median"):
        m = samples.groupBy("channel").agg((F.avg("v") if baseline == "mean" else F.median("v")).alias("base"))
        x = samples.join(m, "channel").withColumn("v", F.abs(F.col("v") - F.col("base")))
    else:
        x = samples.withColumn("v", F.abs(F.col("v") - float(baseline or 0.0)))
    x = x.withColumn("bin", F.floor(F.col("k") / bin_samples).cast("long") if bin_samples else F.lit(0).cast("long"))
    w = Window.partitionBy("channel", "bin").orderBy("k")
    after = F.lead("v").over(w)
    if bin_samples:
        full = F.count("*").over(Window.partitionBy("channel", "bin")) >= bin_samples
        after = F.coalesce(after, F.when(~full, 0.0))
    piece = (F.col("v") + after) / 2 / fs
    return x.withColumn("piece", piece).groupBy("channel", "bin").agg(F.coalesce(F.sum("piece"), F.lit(0.0)).alias("area"))


def derivative(samples: DataFrame, fs: float = 1.0) -> DataFrame:
    """(channel, k, dv): differences to the next sample by the sampling period; times are half a period later."""
    w = Window.partitionBy("channel").orderBy("k")
    return samples.select("channel", "k", ((F.lead("v").over(w) - F.col("v")) * fs).alias("dv")).where(F.col("dv").isNotNull())


def _beyond(threshold: float, sign: str) -> Column:
    if sign not in ("above", "below"):
        raise ValueError("sign is above or below")
    return F.col("v") > threshold if sign == "above" else F.col("v") < threshold


def threshold_runs(samples: DataFrame, threshold: float, sign: str = "above") -> DataFrame:
    """Samples beyond the threshold with the number of their run; a gap in k ends a run."""
    beyond = samples.where(_beyond(threshold, sign))
    gap = F.lag("k").over(Window.partitionBy("channel").orderBy("k"))
    return islands(beyond.withColumn("before", gap), ["channel"], "k", F.coalesce(F.col("k") - F.col("before") > 1, F.lit(True)), "run").drop("before")


def threshold_detection(samples: DataFrame, threshold: float, sign: str = "above") -> DataFrame:
    """(channel, k): the first sample of each run beyond the threshold."""
    return threshold_runs(samples, threshold, sign).groupBy("channel", "run").agg(F.min("k").alias("k")).select("channel", "k")


def peak_detection(samples: DataFrame, threshold: float, sign: str = "above") -> DataFrame:
    """(channel, k, v): the extreme sample of each run, the first on ties."""
    order = F.struct(F.col("v") if sign == "above" else -F.col("v"), -F.col("k"))
    best = F.max_by(F.struct("k", "v"), order)
    return threshold_runs(samples, threshold, sign).groupBy("channel", "run").agg(best.alias("b")).select("channel", "b.k", "b.v")


def snippets(samples: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(channel, event, offset, v): samples from ``before`` before to ``after`` after each event (channel, k);
    events whose snippet leaves the signal are left out."""
    ends = samples.groupBy("channel").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    whole = events.select("channel", F.col("k").alias("event")).join(ends, "channel").where((F.col("event") - before >= F.col("lo")) & (F.col("event") + after - 1 <= F.col("hi")))
    each = whole.select("channel", "event", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("offset"))
    return each.withColumn("k", F.col("event") + F.col("offset")).join(samples.select("channel", "k", "v"), ["channel", "k"]).select("channel", "event", "offset", "v")


def spike_triggered_average(samples: DataFrame, spikes: DataFrame, before: int, after: int) -> DataFrame:
    """(channel, offset, mean, used): mean snippet around events (channel, k)."""
    return snippets(samples, spikes, before, after).groupBy("channel", "offset").agg(F.avg("v").alias("mean"), F.count("*").alias("used"))


def waveform_width(waveforms: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(spike_id, width): samples from the trough (within the first ``cutoff`` part) to the highest sample after it."""
    n = waveforms.groupBy("spike_id").agg(F.count("*").alias("n"))
    x = waveforms.join(n, "spike_id")
    trough = x.where(F.col("k") < F.floor(F.col("n") * cutoff)).groupBy("spike_id").agg(F.min_by("k", F.struct("v", "k")).alias("trough"))
    after = waveforms.join(trough, "spike_id").where("k >= trough")
    return after.groupBy("spike_id").agg((F.max_by("k", F.struct(F.col("v"), -F.col("k"))) - F.first("trough")).alias("width"))


def waveform_snr(waveforms: DataFrame) -> DataFrame:
    """(channel, snr): range of the mean waveform by twice the mean noise, null without noise."""
    per = waveforms.groupBy("channel", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return per.groupBy("channel").agg(((F.max("m") - F.min("m")) / F.nullif(2 * F.avg("sd"), F.lit(0.0))).alias("snr"))


def mean_phase(phases: DataFrame, by: list[str]) -> DataFrame:
    """(by..., angle, length) of the mean of unit vectors."""
    x, y = F.avg(F.cos("phase")), F.avg(F.sin("phase"))
    return phases.groupBy(*by).agg(F.atan2(y, x).alias("angle"), F.sqrt(x * x + y * y).alias("length"))


def phase_difference(a: Column, b: Column) -> Column:
    return F.atan2(F.sin(a - b), F.cos(a - b))


def phase_locking(phases: DataFrame) -> DataFrame:
    """(k, plv): length of the mean over trials of the vectors of phase differences (trial_id, k, a, b)."""
    return mean_phase(phases.withColumn("phase", phase_difference(F.col("a"), F.col("b"))), ["k"]).select("k", F.col("length").alias("plv"))


def spike_phase(analytic: DataFrame, spikes: DataFrame, fs: float, interpolate: bool = False) -> DataFrame:
    """(channel, t, phase, amplitude) at events (channel, t seconds) of an analytic signal (channel, k, re, im):
    an index join at the sample before, or a mean of both neighbours weighted by nearness."""
    at = spikes.withColumn("k", F.floor(F.col("t") * fs).cast("long")).withColumn("part", F.col("t") * fs - F.floor(F.col("t") * fs))
    here = at.join(analytic, ["channel", "k"])
    if not interpolate:
        return here.select("channel", "t", F.atan2("im", "re").alias("phase"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amplitude"))
    following = analytic.select("channel", (F.col("k") - 1).alias("k"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = here.join(following, ["channel", "k"])
    size = lambda r, i: F.sqrt(F.col(r) ** 2 + F.col(i) ** 2)
    unit = lambda c, r, i: F.col(c) / F.nullif(size(r, i), F.lit(0.0))
    w = F.col("part")
    re = (1 - w) * unit("re", "re", "im") + w * unit("re2", "re2", "im2")
    im = (1 - w) * unit("im", "re", "im") + w * unit("im2", "re2", "im2")
    return both.select("channel", "t", F.atan2(im, re).alias("phase"), ((1 - w) * size("re", "im") + w * size("re2", "im2")).alias("amplitude"))


def by_channel(samples: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """``fn(channel, values in order)`` -> dict of arrays, for each channel: what is sequential or dense numerics."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        out = fn(pdf["v"].to_numpy(float))
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], **out})

    return samples.groupBy("channel").applyInPandas(run, schema)


def analytic(x: np.ndarray, padding: bool = True) -> np.ndarray:
    """The analytic signal by the Fourier transform, padded to a power of two by default."""
    n = len(x)
    m = 1 << (n - 1).bit_length() if padding else n
    f = np.fft.fft(x, m)
    h = np.zeros(m)
    h[0] = 1
    h[1 : (m + 1) // 2] = 2
    if m % 2 == 0:
        h[m // 2] = 1
    return np.fft.ifft(f * h)[:n]


def hilbert(samples: DataFrame, padding: bool = True) -> DataFrame:
    """(channel, k, re, im): the analytic signal of each channel."""

    def fn(x: np.ndarray) -> dict:
        z = analytic(x, padding)
        return {"k": np.arange(len(x)), "re": z.real, "im": z.imag}

    return by_channel(samples, fn, f"channel {samples.schema['channel'].dataType.simpleString()}, k long, re double, im double")


def butter_sections(order: int, low: float | None, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Transfer function (b, a) of a digital Butterworth filter by the bilinear transform.

    Only ``low``: frequencies above it pass. Only ``high``: below it. low < high: between; low > high: outside."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    zeros, gain = np.empty(0, complex), 1.0
    if low is None or high is None:
        w = warp(high if low is None else low)
        if low is None:
            p, z, gain = poles * w, zeros, w**order
        else:
            p, z, gain = w / poles, np.zeros(order, complex), 1.0 / np.real(np.prod(-poles))
    else:
        w1, w2 = sorted((warp(low), warp(high)))
        width, centre = w2 - w1, np.sqrt(w1 * w2)
        half = poles * width / 2 if low < high else width / 2 / poles
        root = np.sqrt(half**2 - centre**2 + 0j)
        p = np.concatenate([half + root, half - root])
        if low < high:
            z, gain = np.zeros(order, complex), width**order
        else:
            z, gain = np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)]), 1.0 / np.real(np.prod(-poles))
    fs2 = 2 * fs
    zd, pd_ = (fs2 + z) / (fs2 - z), (fs2 + p) / (fs2 - p)
    gain = gain * np.real(np.prod(fs2 - z) / np.prod(fs2 - p))
    zd = np.concatenate([zd, -np.ones(len(pd_) - len(zd))])
    return np.real(gain * np.poly(zd)), np.real(np.poly(pd_))


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Direct form II transposed, one pass."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    z = np.zeros(n - 1) if state is None else state.copy()
    y = np.empty_like(x)
    for k, v in enumerate(x):
        y[k] = out = b[0] * v + (z[0] if n > 1 else 0.0)
        if n > 1:
            z[:-1] = z[1:]
            z[-1] = 0.0
            z += b[1:] * v - a[1:] * out
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards, over odd extensions at both ends, from the steady state."""
    n = max(len(a), len(b))
    pad = min(3 * n, len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    m = np.eye(n - 1) - np.vstack([np.hstack([-a[1:, None], np.vstack([np.eye(n - 2), np.zeros((1, n - 2))])])])
    zi = np.linalg.solve(m, b[1:] - a[1:] * b[0])
    y = iir(b, a, ext, zi * ext[0])[::-1]
    y = iir(b, a, y, zi * y[0])[::-1]
    return y[pad : pad + len(x)]


def butter(samples: DataFrame, low: float | None = None, high: float | None = None, order: int = 4, fs: float = 1.0, both_ways: bool = True) -> DataFrame:
    """(channel, k, v): Butterworth filtered channels."""
    if low is None and high is None:
        raise ValueError("give low, high or both")
    if any(f is not None and not 0 < f < fs / 2 for f in (low, high)):
        raise ValueError("frequencies must lie between 0 and fs / 2")
    b, a = butter_sections(order, low, high, fs)
    fn = lambda x: {"k": np.arange(len(x)), "v": filtfilt(b, a, x) if both_ways else iir(b, a, x)}
    return by_channel(samples, fn, f"channel {samples.schema['channel'].dataType.simpleString()}, k long, v double")


def wavelet(samples: DataFrame, frequencies: list[float], n_cycles: float = 6.0, fs: float = 1.0, padding: bool = True) -> DataFrame:
    """(channel, frequency, k, re, im): Morlet wavelet transform, in the Fourier domain."""
    if any(not 0 < f < fs / 2 for f in frequencies):
        raise ValueError("frequencies must lie between 0 and fs / 2")

    def fn(x: np.ndarray) -> dict:
        n = len(x)
        m = 1 << n.bit_length() if padding else n
        spectrum, grid = np.fft.fft(x, m), np.fft.fftfreq(m, 1 / fs)
        out = {"frequency": [], "k": [], "re": [], "im": []}
        for f in frequencies:
            sigma = n_cycles / (6 * f)
            w = np.where(grid > 0, 2 * np.exp(-0.5 * (2 * np.pi * sigma * (grid - f)) ** 2), 0.0)
            z = np.fft.ifft(spectrum * w)[:n]
            out["frequency"].append(np.full(n, f))
            out["k"].append(np.arange(n))
            out["re"].append(z.real)
            out["im"].append(z.imag)
        return {k: np.concatenate(v) for k, v in out.items()}

    return by_channel(samples, fn, f"channel {samples.schema['channel'].dataType.simpleString()}, frequency double, k long, re double, im double")
