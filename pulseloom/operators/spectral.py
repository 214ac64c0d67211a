"""Spectra: overlapping segments become rows, each is transformed by itself, and the averages are aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_length(n: int, fs: float, n_segments: int = 8, length: int | None = None, resolution: float | None = None, overlap: float = 0.5) -> int:
    """Samples of a segment: by frequency resolution, else by length, else so that ``n_segments`` overlap in ``n``."""
    if resolution is not None:
        if resolution <= 0:
            raise ValueError("the resolution must be positive")
        length = int(fs / resolution)
    elif length is None:
        length = int(n / (n_segments - overlap * (n_segments - 1)))
    if not 0 < length <= n:
        raise ValueError("a segment must be shorter than the signal")
    return length


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


#: Weights of the cosines of each periodic window.
COSINES = {"boxcar": [1.0], "hann": [0.5, 0.5], "hamming": [0.54, 0.46], "blackman": [0.42, 0.5, 0.08]}


def window(name: str, n: int) -> np.ndarray:
    """A periodic window: a sum of cosines of alternating sign."""
    if name not in COSINES:
        raise ValueError(f"window is one of {sorted(COSINES)}")
    t = 2 * np.pi * np.arange(n) / n
    return sum((-1) ** k * a * np.cos(k * t) for k, a in enumerate(COSINES[name]))


def detrended(seg: np.ndarray, how: str | None) -> np.ndarray:
    """Segments [..., time] without their mean (constant) or their least-squares line (linear), or as they are."""
    if how is None:
        return seg
    if how not in ("constant", "linear"):
        raise ValueError("detrend is constant, linear or None")
    out = seg - seg.mean(axis=-1, keepdims=True)
    if how == "linear":
        t = np.arange(seg.shape[-1]) - (seg.shape[-1] - 1) / 2
        out = out - (out @ t / max(t @ t, 1e-300))[..., None] * t
    return out


#: Points up to which tapers come from the dense eigenproblem; beyond, from a subspace of smooth vectors, and beyond
#: LONG_POINTS (a multiple of the square of the degree) from polynomials, by stretches of POINTS.
DENSE_POINTS, LONG_POINTS, POINTS = 256, 20_000, 4096


def _dense_tapers(m: int, nw: float, k: int) -> np.ndarray:
    """The k leading eigenvectors [taper, point] of the symmetric tridiagonal matrix, m * m numbers in memory."""
    t = np.arange(m)
    diagonal = ((m - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * nw / m)
    off = t[1:] * (m - t[1:]) / 2
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return vectors[:, np.argsort(values)[::-1][:k]].T


def _long_tapers(m: int, nw: float, k: int) -> np.ndarray:
    """The same vectors within the span of Legendre polynomials, by stretches of POINTS: besides the vectors, memory does
    not grow with m.

    They are as smooth as their bandwidth, so that a polynomial's coefficients fall faster than exponentially beyond it.
    The form is written by differences of neighbours, without its constant, so that nothing large cancels."""
    degree = int(1.2 * np.pi * nw) + k + 40
    points = lambda lo, hi: np.polynomial.legendre.legvander(((m - 1) / 2 - np.arange(lo, hi)) / (m / 2), degree)
    gram, form = np.zeros((2, degree + 1, degree + 1))
    for lo in range(0, m, POINTS):
        hi = min(lo + POINTS, m)
        p = points(lo, min(hi + 1, m))
        step, t = np.diff(p, axis=0), np.arange(lo + 1, lo + len(p))
        form -= step.T @ (step * (t * (m - t) / 2)[:, None])
        p = p[: hi - lo]
        gram += p.T @ p
        form -= 2 * np.sin(np.pi * nw / m) ** 2 * (p.T @ (p * (((m - 1) / 2 - np.arange(lo, hi)) ** 2)[:, None]))
    unit = np.linalg.inv(np.linalg.cholesky(gram))
    form = unit @ form @ unit.T
    values, turn = np.linalg.eigh((form + form.T) / 2)
    turn = unit.T @ turn[:, np.argsort(values)[::-1][:k]]
    out = np.empty((k, m))
    for lo in range(0, m, POINTS):
        out[:, lo : lo + POINTS] = (points(lo, min(lo + POINTS, m)) @ turn).T
    return out


def _smooth_tapers(m: int, nw: float, k: int) -> np.ndarray:
    """The same vectors in memory of some vectors more: the band-limiting matrix, which shares them, is applied by transforms
    to some more smooth vectors than are wanted, and the tridiagonal matrix is solved within what these span.

    Its form is written by differences of neighbours, without its constant, so that nothing large cancels."""
    x = (m - 1) / 2 - np.arange(m)
    basis = np.linalg.qr(np.polynomial.legendre.legvander(x / (m / 2), max(k, int(2 * nw)) + 11))[0]
    lag = np.arange(1, m)
    band = np.sin(2 * np.pi * nw / m * lag) / (np.pi * lag)
    points = 1 << (2 * m - 1).bit_length()
    kernel = np.fft.rfft(np.concatenate([[2 * nw / m], band, np.zeros(points - 2 * m + 1), band[::-1]]))
    for _ in range(3):
        for c in range(basis.shape[1]):
            basis[:, c] = np.fft.irfft(np.fft.rfft(basis[:, c], points) * kernel, points)[:m]
        basis = np.linalg.qr(basis)[0]
    off = np.arange(1, m) * (m - np.arange(1, m)) / 2
    step = np.diff(basis, axis=0)
    form = -2 * np.sin(np.pi * nw / m) ** 2 * (basis.T @ (basis * (x**2)[:, None])) - step.T @ (step * off[:, None])
    values, turn = np.linalg.eigh((form + form.T) / 2)
    return np.ascontiguousarray((basis @ turn[:, np.argsort(values)[::-1][:k]]).T)


@lru_cache(maxsize=2)
def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """k periodic discrete prolate spheroidal tapers, by the symmetric tridiagonal eigenproblem of n + 1 points."""
    long = n >= max(LONG_POINTS, (int(1.2 * np.pi * nw) + k + 40) ** 2)  # where the polynomials are still apart
    out = (_dense_tapers if n < DENSE_POINTS else _long_tapers if long else _smooth_tapers)(n + 1, nw, k)
    for i, v in enumerate(out):
        # Even tapers have a positive mean, odd ones start upwards.
        flip = v.sum() < 0 if i % 2 == 0 else v[np.argmax(np.abs(v) > 1e-7 * np.abs(v).max())] < 0
        if flip:
            out[i] = -v
    out = out[:, :-1]
    out.flags.writeable = False
    return out


def _segments(x: np.ndarray, length: int, overlap: float) -> np.ndarray:
    step = max(1, length - int(length * overlap))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::step]


def cross_spectra(x: np.ndarray, fs: float, length: int, overlap: float, tapers: np.ndarray | None, one_sided: bool = True, taper: str = "hann", detrend: str | None = "constant", scaling: str = "density", nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, spectra [i, j, f]) of channels x [i, t], averaged over segments and tapers.

    Without tapers, segments are detrended, windowed, and padded with zeros to ``nfft``; they are scaled to a density, or to a power spectrum. ``one_sided`` doubles what has a negative frequency (with
    tapers, all but frequency zero)."""
    if scaling not in ("density", "spectrum"):
        raise ValueError("scaling is density or spectrum")
    windows = window(taper, length)[None] if tapers is None else tapers
    points = length if tapers is not None else nfft or length
    if points < length:
        raise ValueError("nfft is at least a segment's length")
    total = None
    for parts in zip(*(_segments(c, length, overlap) for c in x), strict=True):
        seg = np.array(parts)
        if tapers is None:
            seg = detrended(seg, detrend)
        whole = (windows.sum() ** 2 if scaling == "spectrum" else fs * (windows**2).sum()) if tapers is None else fs * len(windows)
        for w in windows:  # one at a time: a segment's transforms are as large as its tapers
            f = np.fft.rfft(seg * w, points, axis=-1)
            s = np.conj(f)[:, None] * f[None]
            s /= whole
            total = s if total is None else np.add(total, s, out=total)
    count = len(_segments(x[0], length, overlap))
    out = total / count
    stop = -1 if points % 2 == 0 and tapers is None else None
    if one_sided:
        out[..., 1:stop] *= 2
    return np.fft.rfftfreq(points, 1 / fs), out


def _in_order(t: pa.Table) -> np.ndarray:
    """The values v of one channel in order of k."""
    return t.column("v").to_numpy()[np.argsort(t.column("k").to_numpy(), kind="stable")].astype(float, copy=False)


def _channels(t: pa.Table) -> tuple[list, np.ndarray]:
    """The channels of (channel, k, v) in order, and their values [channel, time]; what a channel has not is NaN."""
    channel, k = t.column("channel").to_numpy(), t.column("k").to_numpy()
    names, times, order = np.unique(channel), [], []
    for c in names:
        own = np.flatnonzero(channel == c)
        order.append(own[np.argsort(k[own], kind="stable")])
        times.append(k[order[-1]])
        if (times[-1][1:] == times[-1][:-1]).any():
            raise ValueError("a channel has two values of one time")
    v = t.column("v").to_numpy().astype(float, copy=False)
    if all(np.array_equal(times[0], x) for x in times):
        return names.tolist(), np.array([v[o] for o in order])
    every = np.unique(np.concatenate(times))
    x = np.full((len(names), len(every)), np.nan)
    for row, at, o in zip(x, times, order, strict=True):
        row[np.searchsorted(every, at)] = v[o]
    return names.tolist(), x


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _by_groups(samples: DataFrame, by: str, fn: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``fn(rows)`` -> dict of arrays for each value of ``by``, after that."""
    types = dict(x.split() for x in schema.split(", "))

    def run(t: pa.Table) -> pa.Table:
        key = t.column(by)[0]
        found = fn(t)
        del t
        columns = {c: pa.array(found.pop(c), KINDS[kind]) for c, kind in types.items()}
        return pa.table({by: pa.repeat(key, len(next(iter(columns.values())))), **columns})

    return samples.groupBy(by).applyInArrow(run, f"{by} {samples.schema[by].dataType.simpleString()}, {schema}")


def _grouped(samples: DataFrame, by: str, fn: Callable[[list, np.ndarray], dict], schema: str) -> DataFrame:
    """``fn(channels, x [channel, time])`` -> dict of arrays for each value of ``by``."""
    return _by_groups(samples.select(by, "channel", "k", "v"), by, lambda t: fn(*_channels(t)), schema)


def welch_psd(samples: DataFrame, fs: float = 1.0, overlap: float = 0.5, taper: str = "hann", detrend: str | None = "constant", scaling: str = "density", nfft: int | None = None, **segments) -> DataFrame:  # noqa: ANN003
    """(channel, freq, psd) of each channel by itself, by the window, trend, scale and padding of ``cross_spectra``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("k")["v"].to_numpy(float)
        f, s = cross_spectra(x[None], fs, segment_length(len(x), fs, overlap=overlap, **segments), overlap, None, True, taper, detrend, scaling, nfft)
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "freq": f, "psd": s[0, 0].real})

    return samples.groupBy("channel").applyInPandas(run, f"channel {samples.schema['channel'].dataType.simpleString()}, freq double, psd double")


def multitaper_psd(samples: DataFrame, fs: float = 1.0, nw: float = 4.0, n_tapers: int | None = None, n_segments: int = 1, overlap: float = 0.5, **segments) -> DataFrame:  # noqa: ANN003
    """(channel, freq, psd) with 2 * nw - 1 tapers, on the whole signal or averaged over segments."""

    def fn(t: pa.Table) -> dict:
        x = _in_order(t)
        length = segment_length(len(x), fs, n_segments, overlap=overlap, **segments)
        f, s = cross_spectra(x[None], fs, length, overlap, dpss(length, nw, n_tapers or int(2 * nw) - 1))
        return {"freq": f, "psd": s[0, 0].real}

    return _by_groups(samples.select("channel", "k", "v"), "channel", fn, "freq double, psd double")


def multitaper_cross_spectrum(samples: DataFrame, by: str = "recording", fs: float = 1.0, nw: float = 4.0, n_segments: int = 1, overlap: float = 0.5) -> DataFrame:
    """(by, i, j, freq, re, im) of all channel pairs of each recording."""

    def fn(channels: list, x: np.ndarray) -> dict:
        length = segment_length(x.shape[1], fs, n_segments, overlap=overlap)
        f, s = cross_spectra(x, fs, length, overlap, dpss(length, nw, int(2 * nw) - 1), one_sided=False)
        n, m = len(channels), len(f)
        i, j = np.divmod(np.arange(n * n), n)
        c = np.array(channels)
        flat = s.reshape(n * n, m).ravel()
        return {"i": np.repeat(c[i], m), "j": np.repeat(c[j], m), "freq": np.tile(f, n * n), "re": flat.real, "im": flat.imag}

    return _grouped(samples, by, fn, "i int, j int, freq double, re double, im double")


def coherence(samples: DataFrame, by: str = "recording", fs: float = 1.0, multitaper: bool = False, nw: float = 4.0, n_segments: int = 8, overlap: float = 0.5, taper: str = "hann", detrend: str | None = "constant", nfft: int | None = None) -> DataFrame:
    """(by, freq, coherence, phase_lag) of recordings of two channels: |S01|^2 / (S00 S11) and the angle of S01.
    Window, trend and padding are Welch's; with ``multitaper`` they are not looked at."""

    def fn(channels: list, x: np.ndarray) -> dict:
        length = segment_length(x.shape[1], fs, n_segments, overlap=overlap)
        f, s = cross_spectra(x[:2], fs, length, overlap, dpss(length, nw, int(2 * nw) - 1) if multitaper else None, taper=taper, detrend=detrend, nfft=nfft)
        return {"freq": f, "coherence": np.abs(s[0, 1]) ** 2 / (s[0, 0].real * s[1, 1].real), "phase_lag": np.angle(s[0, 1])}

    return _grouped(samples, by, fn, "freq double, coherence double, phase_lag double")


def weighted_phase_lag_index(samples: DataFrame, fs: float = 1.0) -> DataFrame:
    """(freq, wpli) of two channels (0 and 1) over trials: |mean of Im S| by the mean of |Im S|."""

    def fn(channels: list, x: np.ndarray) -> dict:
        f = np.fft.rfft(x, axis=1)
        return {"freq": np.fft.rfftfreq(x.shape[1], 1 / fs), "im": np.imag(f[0] * np.conj(f[1]))}

    each = _grouped(samples, "trial_id", fn, "freq double, im double")
    return each.groupBy("freq").agg((F.abs(F.avg("im")) / F.nullif(F.avg(F.abs("im")), F.lit(0.0))).alias("wpli"))


def welch_cohere(samples: DataFrame, by: str = "recording", fs: float = 1.0, n_segments: int = 8, overlap: float = 0.5) -> DataFrame:
    """Coherence by Welch's method (an older name)."""
    return coherence(samples, by, fs, False, n_segments=n_segments, overlap=overlap)


def spike_field_coherence(samples: DataFrame, spikes: DataFrame, fs: float = 1.0, length: int = 256, overlap: float = 0.5) -> DataFrame:
    """(channel, freq, coherence) of each channel (channel, k, v) with the counts of its events (channel, k): Welch's
    method on segments of ``length`` samples, or of the whole signal if that is shorter."""
    counts = spikes.groupBy("channel", "k").agg(F.count("*").cast("double").alias("n"))
    joined = samples.join(counts, ["channel", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("k")[["n", "v"]].to_numpy(float).T
        f, s = cross_spectra(x, fs, min(length, x.shape[1]), overlap, None)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.abs(s[0, 1]) ** 2 / (s[0, 0].real * s[1, 1].real)
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "freq": f, "coherence": c})

    return joined.groupBy("channel").applyInPandas(run, f"channel {samples.schema['channel'].dataType.simpleString()}, freq double, coherence double")
