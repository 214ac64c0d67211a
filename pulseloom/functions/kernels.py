"""Kernels: densities as Columns, taps as small tables, areas and quantiles as numbers.

Each has standard deviation ``sigma``; ``inverted`` mirrors the causal ones in time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("rectangular", "triangular", "epanechnikov", "gaussian", "laplacian", "exponential", "alpha")


@dataclass(frozen=True)
class Kernel:
    name: str
    sigma: float
    inverted: bool = False

    def __post_init__(self) -> None:
        if self.name not in NAMES:
            raise ValueError(f"no kernel {self.name}")
        if self.sigma <= 0:
            raise ValueError("sigma must be positive")

    @property
    def symmetric(self) -> bool:
        return self.name not in ("exponential", "alpha")

    def density(self, t: Column) -> Column:
        """The density at ``t`` (in sigma's unit)."""
        s, t = self.sigma, -t if self.inverted and not self.symmetric else t
        if self.name == "rectangular":
            r = math.sqrt(3) * s
            return F.when(F.abs(t) < r, F.lit(1 / (2 * r))).otherwise(0.0)
        if self.name == "triangular":
            r = math.sqrt(6) * s
            return F.greatest(F.lit(0.0), (1 - F.abs(t) / r) / r)
        if self.name == "epanechnikov":
            r = math.sqrt(5) * s
            return F.greatest(F.lit(0.0), F.lit(0.75 / r) * (1 - F.pow(t / r, 2)))
        if self.name == "gaussian":
            return F.exp(-0.5 * F.pow(t / s, 2)) / F.lit(math.sqrt(2 * math.pi) * s)
        if self.name == "laplacian":
            return F.exp(-math.sqrt(2) * F.abs(t) / s) / F.lit(math.sqrt(2) * s)
        if self.name == "exponential":
            return F.when(t >= 0, F.exp(-t / s) / s).otherwise(0.0)
        tau = s / math.sqrt(2)
        return F.when(t >= 0, t / (tau * tau) * F.exp(-t / tau)).otherwise(0.0)

    def pdf(self, t: float) -> float:
        s, t = self.sigma, -t if self.inverted and not self.symmetric else t
        if self.name == "rectangular":
            r = math.sqrt(3) * s
            return 1 / (2 * r) if abs(t) < r else 0.0
        if self.name == "triangular":
            r = math.sqrt(6) * s
            return max(0.0, (1 - abs(t) / r) / r)
        if self.name == "epanechnikov":
            r = math.sqrt(5) * s
            return max(0.0, 0.75 / r * (1 - (t / r) ** 2))
        if self.name == "gaussian":
            return math.exp(-0.5 * (t / s) ** 2) / (math.sqrt(2 * math.pi) * s)
        if self.name == "laplacian":
            return math.exp(-math.sqrt(2) * abs(t) / s) / (math.sqrt(2) * s)
        if self.name == "exponential":
            return math.exp(-t / s) / s if t >= 0 else 0.0
        tau = s / math.sqrt(2)
        return t / tau**2 * math.exp(-t / tau) if t >= 0 else 0.0

    def cdf(self, t: float) -> float:
        if self.inverted and not self.symmetric:
            return 1 - Kernel(self.name, self.sigma).cdf(-t)
        s = self.sigma
        if self.name == "rectangular":
            r = math.sqrt(3) * s
            return min(1.0, max(0.0, (t + r) / (2 * r)))
        if self.name == "triangular":
            x = max(-1.0, min(1.0, t / (math.sqrt(6) * s)))
            return 0.5 * (1 + x) ** 2 if x < 0 else 1 - 0.5 * (1 - x) ** 2
        if self.name == "epanechnikov":
            x = max(-1.0, min(1.0, t / (math.sqrt(5) * s)))
            return 0.5 + 0.75 * (x - x**3 / 3)
        if self.name == "gaussian":
            return NormalDist(0, s).cdf(t)
        if self.name == "laplacian":
            e = 0.5 * math.exp(-math.sqrt(2) * abs(t) / s)
            return e if t < 0 else 1 - e
        if t < 0:
            return 0.0
        if self.name == "exponential":
            return 1 - math.exp(-t / s)
        x = t * math.sqrt(2) / s
        return 1 - math.exp(-x) * (1 + x)

    def icdf(self, fraction: float) -> float:
        """The quantile, by bisection of the cdf."""
        if not 0 <= fraction < 1:
            raise ValueError("a fraction in [0, 1) is needed")
        lo, hi = -60 * self.sigma, 60 * self.sigma
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.cdf(mid) < fraction else (lo, mid)
        return hi

    def boundary(self, fraction: float) -> float:
        """The t whose interval from -t (or from 0, for causal kernels) to t holds a fraction of the area."""
        return abs(self.icdf((1 + fraction) / 2 if self.symmetric else 1 - fraction if self.inverted else fraction))

    @property
    def cutoff(self) -> float:
        """The least cutoff, in sigmas: where bounded kernels end, and where the others are negligible."""
        return {"rectangular": math.sqrt(3), "triangular": math.sqrt(6), "epanechnikov": math.sqrt(5), "gaussian": 3.0, "laplacian": 3.0, "exponential": 3.0, "alpha": 3.0}[self.name]

    def median_index(self, times: list[float]) -> int:
        """First index whose time is at or after the median of the area between the first and last time."""
        median = self.icdf((self.cdf(times[0]) + self.cdf(times[-1])) / 2)
        return next((i for i, t in enumerate(times) if t >= median), len(times) - 1)

    def taps(self, period: float, cutoff: float = 5.0, center: bool = False) -> list[tuple[int, float]]:
        """(offset, density): the fewest points at most ``period`` apart that divide ``cutoff`` sigmas on both
        sides evenly, around zero or (``center``) around the median."""
        end = max(cutoff, self.cutoff) * self.sigma
        reach = math.ceil(end / period)
        middle = self.icdf(0.5) if center and not self.symmetric else 0.0
        return [(k, self.pdf(middle + k * end / reach)) for k in range(-reach, reach + 1)]
