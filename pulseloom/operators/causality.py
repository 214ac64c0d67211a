"""Granger causality: lag moments or spectra of a recording, small linear algebra in one task for each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pulseloom.operators.spectral import cross_spectra, dpss, segment_length


def lag_covariances(x: np.ndarray, most: int) -> np.ndarray:
    """Mean outer products by lag 0..most of centred channels x [i, t]."""
    x = x - x.mean()
    return np.array([x[:, lag:] @ x[:, : x.shape[1] - lag].T / (x.shape[1] - lag) for lag in range(most + 1)])


def autoregression(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients [lag, i, j], residual covariance) by the Yule-Walker equations."""
    d, c = len(x), lag_covariances(x, order)
    block = np.block([[c[a - b] if a >= b else c[b - a].T for a in range(order)] for b in range(order)])
    right = np.hstack([c[k] for k in range(1, order + 1)])
    coef = np.linalg.lstsq(block.T, right.T, rcond=None)[0].T
    lags = coef.reshape(d, order, d).transpose(1, 0, 2)
    return lags, c[0] - sum(lags[k] @ c[k + 1].T for k in range(order))


def criterion(cov: np.ndarray, order: int, d: int, n: int, kind: str) -> float:
    penalty = {"aic": 2.0, "bic": np.log(n)}[kind]
    return 2 * float(np.linalg.slogdet(np.atleast_2d(cov))[1]) + penalty * d * d * order / n


def best_autoregression(x: np.ndarray, most: int, kind: str = "aic") -> tuple[int, np.ndarray, np.ndarray]:
    fits = [(criterion(cov, p, len(x), x.shape[1], kind), p, lags, cov) for p in range(1, most + 1) for lags, cov in [autoregression(x, p)]]
    return min(fits, key=lambda f: f[0])[1:]


def _rounded(v: float, n: int) -> float:
    return round(float(v), round(-np.log10(1 / np.sqrt(n))))


def pairwise(x: np.ndarray, most: int, kind: str = "aic") -> tuple[float, float, float, float]:
    """(x to y, y to x, instantaneous, total) of two channels."""
    n = x.shape[1]
    cx, cy = (float(best_autoregression(x[i : i + 1], most, kind)[2].ravel()[0]) for i in (0, 1))
    c = best_autoregression(x, most, kind)[2]
    det = float(np.linalg.det(c))
    xy, yx = np.log(cy / c[1, 1]), np.log(cx / c[0, 0])
    now = np.log(c[0, 0] * c[1, 1] / det)
    return tuple(_rounded(v, n) for v in (xy, yx, now, np.log(cx * cy / det)))


def conditional(x: np.ndarray, most: int, kind: str = "aic") -> float:
    """Of channel 1 on channel 0, given channel 2."""
    without, full = best_autoregression(x[[0, 2]], most, kind)[2], best_autoregression(x, most, kind)[2]
    return _rounded(np.log(without[0, 0] / full[0, 0]), x.shape[1])


def spectral_factor(s: np.ndarray, steps: int = 300, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(noise covariance, transfer function [f, i, j]) of two-sided spectra s [f, i, j], by Wilson's iteration."""
    m, d = s.shape[0], s.shape[1]
    start = np.linalg.cholesky(np.fft.ifft(s, axis=0)[0].real)
    psi = np.repeat(start[None].astype(complex), m, axis=0)
    for _ in range(steps):
        inv = np.linalg.inv(psi)
        g = inv @ s @ np.conj(inv.transpose(0, 2, 1)) + np.eye(d)
        lags = np.fft.ifft(g, axis=0)
        lags[0] = np.triu(lags[0], 1) + np.diag(np.diag(lags[0])) / 2
        lags[m // 2 + 1 :] = 0
        if m % 2 == 0:
            lags[m // 2] /= 2
        new = psi @ np.fft.fft(lags, axis=0)
        gap = np.abs(new - psi).max()
        psi = new
        if gap < tolerance * np.abs(psi).max():
            break
    else:
        raise ValueError(f"the spectral factorization has not converged in {steps} steps")
    a0 = np.fft.ifft(psi, axis=0)[0].real
    return a0 @ a0.T, psi @ np.linalg.inv(a0)


def spectral_granger(x: np.ndarray, fs: float, nw: float = 4.0, n_segments: int = 1) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Frequencies and the four measures by frequency."""
    length = segment_length(x.shape[1], fs, n_segments)
    f, one = cross_spectra(x, fs, length, 0.5, dpss(length, nw, int(2 * nw) - 1))
    half = np.conj(one).transpose(2, 0, 1).copy()
    half[1:] /= 2
    tail = np.conj(half[1 : (length + 1) // 2][::-1])
    cov, h = spectral_factor(np.concatenate([half, tail]))
    h, s = h[: len(f)], half
    xy = np.log(s[:, 1, 1].real / (s[:, 1, 1].real - (cov[0, 0] - cov[0, 1] ** 2 / cov[1, 1]) * np.abs(h[:, 1, 0]) ** 2))
    yx = np.log(s[:, 0, 0].real / (s[:, 0, 0].real - (cov[1, 1] - cov[0, 1] ** 2 / cov[0, 0]) * np.abs(h[:, 0, 1]) ** 2))
    total = np.log(s[:, 0, 0].real * s[:, 1, 1].real / np.linalg.det(s).real)
    return f, {"x_to_y": xy, "y_to_x": yx, "instantaneous": total - xy - yx, "total": total}


def granger(samples: DataFrame, by: str, most: int, kind: str = "aic") -> DataFrame:
    """(by, x_to_y, y_to_x, instantaneous, total) of recordings of two channels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="k", columns="channel", values="v").sort_index().to_numpy(float).T
        return pd.DataFrame([[pdf[by].iloc[0], *pairwise(x, most, kind)]], columns=[by, "x_to_y", "y_to_x", "instantaneous", "total"])

    return samples.groupBy(by).applyInPandas(run, f"{by} {samples.schema[by].dataType.simpleString()}, x_to_y double, y_to_x double, instantaneous double, total double")


def conditional_granger(samples: DataFrame, by: str, most: int, kind: str = "aic") -> DataFrame:
    """(by, causality) of recordings of three channels: channel 1 on channel 0 given channel 2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="k", columns="channel", values="v").sort_index().to_numpy(float).T
        return pd.DataFrame([[pdf[by].iloc[0], conditional(x, most, kind)]], columns=[by, "causality"])

    return samples.groupBy(by).applyInPandas(run, f"{by} {samples.schema[by].dataType.simpleString()}, causality double")


def spectral(samples: DataFrame, by: str, fs: float = 1.0, n_segments: int = 1) -> DataFrame:
    """(by, freq, x_to_y, y_to_x, instantaneous, total) of recordings of two channels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="k", columns="channel", values="v").sort_index().to_numpy(float).T
        f, m = spectral_granger(x, fs, n_segments=n_segments)
        return pd.DataFrame({by: pdf[by].iloc[0], "freq": f, **m})

    return samples.groupBy(by).applyInPandas(run, f"{by} {samples.schema[by].dataType.simpleString()}, freq double, x_to_y double, y_to_x double, instantaneous double, total double")
