"""Source density: potentials at electrodes to current sources.

An estimator is a matrix from electrodes to outputs, made once on the driver from a few positions; applying it
to any number of samples is a join with that matrix and a sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.plans.builders import literal_table


def standard_csd(samples: DataFrame, spacing: float, sigma: float = 0.3, edges: bool = True) -> DataFrame:
    """(channel, k, csd): -sigma / spacing times the second difference over depth. ``edges`` repeats the end
    contacts; without it, an end's value is its own potential by sigma / spacing."""
    w = Window.partitionBy("k").orderBy("channel")
    up, down = F.lag("v").over(w), F.lead("v").over(w)
    if edges:
        up, down = F.coalesce(up, F.col("v")), F.coalesce(down, F.col("v"))
    inner = up - 2 * F.col("v") + down
    return samples.select("channel", "k", (-sigma * F.coalesce(inner, -F.col("v")) / spacing).alias("csd"))


def delta_matrix(z: np.ndarray, diameter: float, sigma: float = 0.3, sigma_top: float = 0.3) -> np.ndarray:
    """Sources (A / m3) from potentials, for thin discs at the contacts (and their images above)."""
    h = abs(np.diff(z))[0]
    r2 = (diameter / 2) ** 2
    f = lambda d: np.sqrt(d**2 + r2) - np.abs(d)
    a = h / (2 * sigma) * (f(z[:, None] - z[None]) + (sigma - sigma_top) / (sigma + sigma_top) * f(z[:, None] + z[None]))
    return np.linalg.inv(a)


def step_matrix(z: np.ndarray, diameter: float, sigma: float = 0.3, sigma_top: float = 0.3, points: int = 64) -> np.ndarray:
    """For cylinders of contact spacing, by Gauss-Legendre quadrature over each."""
    h = abs(np.diff(z))[0]
    r2 = (diameter / 2) ** 2
    x, w = np.polynomial.legendre.leggauss(points)
    inner = z[:, None] + x[None] * h / 2
    f = lambda d: np.sqrt(d**2 + r2) - np.abs(d)
    a = np.array([[np.sum(w * h / 2 * (f(e - s) + (sigma - sigma_top) / (sigma + sigma_top) * f(e + s))) for s in inner] for e in z]) / (2 * sigma)
    return np.linalg.inv(a)


def natural_spline(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Matrix from values at ``z`` to a natural cubic spline's values at ``at``."""
    n, h = len(z), np.diff(z)
    a, b = np.eye(n), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    second = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(z, at) - 1, 0, n - 2)
    t, s = at - z[k], z[k + 1] - at
    e = np.eye(n)
    return (second[k] * (s**3)[:, None] + second[k + 1] * (t**3)[:, None]) / (6 * h[k])[:, None] + (e[k] / h[k][:, None] - second[k] * (h[k] / 6)[:, None]) * s[:, None] + (e[k + 1] / h[k][:, None] - second[k + 1] * (h[k] / 6)[:, None]) * t[:, None]


def spline_matrix(z: np.ndarray, diameter: float, out: np.ndarray, sigma: float = 0.3, points: int = 400) -> np.ndarray:
    """For sources that vary as a natural spline over depth."""
    h = abs(np.diff(z))[0]
    r2 = (diameter / 2) ** 2
    grid = np.linspace(z[0] - h / 2, z[-1] + h / 2, points)
    d = z[:, None] - grid[None]
    forward = (np.sqrt(d**2 + r2) - np.abs(d)) / (2 * sigma) * (grid[1] - grid[0])
    inside = natural_spline(z, np.clip(grid, z[0], z[-1]))
    return natural_spline(z, out) @ np.linalg.inv(forward @ inside)


def gauss(distance: np.ndarray, stdev: float, dim: int) -> np.ndarray:
    return np.exp(-0.5 * (distance / stdev) ** 2) / (np.sqrt(2 * np.pi) * stdev) ** dim


def kernel_matrix(electrodes: np.ndarray, out: np.ndarray, width: float, lam: float = 0.0, sigma: float = 0.3, h: float = 1.0, n_sources: int = 300) -> np.ndarray:
    """Kernel estimator in 1, 2 or 3 dimensions (rows are positions): Gaussian sources on a grid, their potentials at
    the electrodes by quadrature, and a ridge inverse."""
    electrodes, out = np.atleast_2d(electrodes), np.atleast_2d(out)
    dim = electrodes.shape[1]
    lo, hi = np.minimum(electrodes.min(0), out.min(0)) - width, np.maximum(electrodes.max(0), out.max(0)) + width
    per = max(4, round(n_sources ** (1 / dim)))
    src = np.stack(np.meshgrid(*[np.linspace(a, b, per) for a, b in zip(lo, hi, strict=True)], indexing="ij"), -1).reshape(-1, dim)
    reach = np.linspace(-3 * width, 3 * width, {1: 201, 2: 31, 3: 13}[dim])
    cell = np.stack(np.meshgrid(*[reach] * dim, indexing="ij"), -1).reshape(-1, dim)
    mass = gauss(np.linalg.norm(cell, axis=1), width, dim) * (reach[1] - reach[0]) ** dim

    def potential(d: np.ndarray) -> float:
        r = np.linalg.norm(d[None] - cell, axis=1)
        if dim == 1:
            k = np.sqrt(r**2 + h**2) - r
        elif dim == 2:
            k = np.arcsinh(2 * h / np.maximum(r, (reach[1] - reach[0]) / 4)) / np.pi
        else:
            k = 1 / (2 * np.pi * np.maximum(r, (reach[1] - reach[0]) / 4))
        return float((k * mass).sum() / (2 * sigma))

    # Potentials depend on the distance only: a table, then interpolation.
    far = np.linalg.norm(hi - lo) * 1.01
    table_at = np.linspace(0, far, 200)
    first = np.zeros(dim)
    first[0] = 1.0
    table_v = np.array([potential(t * first) for t in table_at])
    dist = lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=2)
    b_pot = np.interp(dist(src, electrodes), table_at, table_v)
    b_src = gauss(dist(src, out), width, dim)
    k_pot, k_cross = b_pot.T @ b_pot, b_src.T @ b_pot
    return k_cross @ np.linalg.inv(k_pot + lam * np.trace(k_pot) / len(k_pot) * np.eye(len(k_pot)))


def cross_validate(potentials: np.ndarray, electrodes: np.ndarray, widths: list[float], lambdas: list[float]) -> tuple[float, float, float]:
    """(width, lambda, error) of the least error when each electrode is predicted from the others; potentials [electrode, time]."""
    best = None
    n = len(electrodes)
    for w in widths:
        k = gauss(np.linalg.norm(electrodes[:, None] - electrodes[None], axis=2), 2 * w, electrodes.shape[1])
        for lam in lambdas:
            err = 0.0
            for i in range(n):
                rest = [j for j in range(n) if j != i]
                m = k[np.ix_(rest, rest)]
                beta = np.linalg.solve(m + lam * np.trace(m) / len(m) * np.eye(n - 1), potentials[rest])
                err += float(np.linalg.norm(potentials[i] - k[i, rest] @ beta))
            if best is None or err < best[2]:
                best = (w, lam, err)
    return best


def apply_matrix(samples: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(out, k, csd): the matrix [out, channel] times the samples."""
    rows = [(int(o), int(c), float(matrix[o, c])) for o in range(matrix.shape[0]) for c in range(matrix.shape[1])]
    m = literal_table(samples.sparkSession, rows, "out int, channel int, m double")
    return samples.join(m, "channel").groupBy("out", "k").agg(F.sum(F.col("m") * F.col("v")).alias("csd"))


def smooth_depth(csd: DataFrame, taps: list[float]) -> DataFrame:
    """(out, k, csd) with each sample convolved over depth by normalised taps; contacts beyond the ends count as zero."""
    total, mid = sum(taps), len(taps) // 2
    t = literal_table(csd.sparkSession, [(k - mid, w / total) for k, w in enumerate(taps)], "offset int, w double")
    inside = csd.select("out", "k")
    moved = csd.crossJoin(t).withColumn("out", F.col("out") + F.col("offset")).groupBy("out", "k").agg(F.sum(F.col("csd") * F.col("w")).alias("csd"))
    return moved.join(inside, ["out", "k"], "left_semi")


def generate_lfp(profile, electrodes: np.ndarray, limits: tuple[float, float] = (0.0, 1.0), points: int = 51, h: float = 1.0, sigma: float = 0.3) -> np.ndarray:  # noqa: ANN001
    """Potentials at 1-D electrodes of a source profile, by Simpson's rule."""
    x = np.linspace(*limits, points | 1)
    w = np.ones(len(x))
    w[1:-1:2], w[2:-1:2] = 4, 2
    w *= (x[1] - x[0]) / 3
    d = np.abs(electrodes[:, None] - x[None])
    return (np.sqrt(d**2 + h**2) - d) @ (w * profile(x)) / (2 * sigma)


def electrode_grid(dim: int, low: float = 0.1, high: float = 0.9, n: int = 5) -> np.ndarray:
    return np.stack(np.meshgrid(*[np.linspace(low, high, n)] * dim, indexing="ij"), -1).reshape(-1, dim)


def duplicated(positions: DataFrame) -> DataFrame:
    """Whether two electrodes (channel, x, y, z) share a place."""
    return positions.agg((F.count("*") > F.count_distinct(F.struct("x", "y", "z"))).alias("duplicated"))


def dipole(x: np.ndarray) -> np.ndarray:
    """A profile between 0 and 1: a Gaussian source at 0.7 and a sink of the same size at 0.3, of variance 0.3."""
    bump = lambda at: np.exp(-((x - at) ** 2) / 0.6) / np.sqrt(0.6 * np.pi)
    return (bump(0.7) - bump(0.3)) / 2


METHODS = ("standard", "delta", "step", "spline", "kernel")


def estimate_csd(samples: DataFrame, z: np.ndarray, method: str = "standard", diameter: float = 0.5, sigma: float = 0.3, out: np.ndarray | None = None, width: float = 0.15, lam: float = 1e-3) -> DataFrame:
    """(channel or place, k, csd) of potentials (channel, k, v) at depths ``z``, by the method's name."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    z = np.asarray(z, float)
    if len(np.unique(z)) < len(z):
        raise ValueError("two contacts are at one place")
    if method == "standard":
        gaps = np.diff(z)
        if not np.allclose(gaps, gaps[0]):
            raise ValueError("the standard method needs evenly spaced contacts")
        return standard_csd(samples, float(abs(gaps[0])), sigma)
    out = z if out is None else np.asarray(out, float)
    matrix = {
        "delta": lambda: delta_matrix(z, diameter, sigma), "step": lambda: step_matrix(z, diameter, sigma),
        "spline": lambda: spline_matrix(z, diameter, out, sigma), "kernel": lambda: kernel_matrix(z[:, None], out[:, None], width, lam, sigma),
    }[method]()
    return apply_matrix(samples, matrix)
