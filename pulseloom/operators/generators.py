"""Generators: point processes and autoregressive signals as row sources.

Trains are made in parallel; each has a generator seeded by (seed, train), so a lost task makes the same train again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN = "train_id long, t double"


def _renewal(draw: Callable, rate: float, start: float, stop: float, equilibrium: bool) -> np.ndarray:
    """Cumulated intervals in chunks until ``stop``; in equilibrium, the process has run before ``start``."""
    t = start - (20 / rate if equilibrium else 0.0)
    out = []
    while t < stop:
        n = int((stop - t) * rate) + 1
        steps = t + np.cumsum(draw(n + int(3 * np.sqrt(n)) + 1))
        out.append(steps)
        t = steps[-1]
    every = np.concatenate(out) if out else np.empty(0)
    return every[(every >= start) & (every < stop)]


def intervals_of(kind: str, rng: np.random.Generator, rate: float, **p: float) -> Callable[[int], np.ndarray]:
    """A drawer of intervals with mean 1 / rate."""
    if kind == "poisson":
        dead = p.get("refractory", 0.0)
        if dead * rate >= 1:
            raise ValueError("the refractory period is longer than the mean interval")
        return lambda n: dead + rng.exponential(1 / rate - dead, n)
    if kind == "gamma":
        return lambda n: rng.gamma(p["shape"], 1 / (rate * p["shape"]), n)
    if kind == "lognormal":
        return lambda n: rng.lognormal(-np.log(rate) - p["sigma"] ** 2 / 2, p["sigma"], n)
    if kind == "inverse_gaussian":
        return lambda n: rng.wald(1 / rate, 1 / (rate * p["cv"] ** 2), n)
    raise ValueError(f"no process {kind}")


def _trains(spark: SparkSession, n: int, seed: int, make: Callable[[np.random.Generator, int], np.ndarray]) -> DataFrame:
    def run(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            for i in pdf["id"]:
                t = make(np.random.default_rng([seed, int(i)]), int(i))
                yield pd.DataFrame({"train_id": np.full(len(t), i, np.int64), "t": t})

    return spark.range(0, n, 1, min(n, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(run, TRAIN)


def stationary(spark: SparkSession, kind: str, n: int, rate: float, start: float = 0.0, stop: float = 1.0, equilibrium: bool = True, seed: int = 0, **p: float) -> DataFrame:
    """(train_id, t): n trains of a stationary Poisson, gamma, lognormal or inverse Gaussian process."""
    return _trains(spark, n, seed, lambda rng, _: _renewal(intervals_of(kind, rng, rate, **p), rate, start, stop, equilibrium) if rate > 0 else np.empty(0))


def modulated(spark: SparkSession, kind: str, n: int, rates: list[float], period: float, seed: int = 0, **p: float) -> DataFrame:
    """(train_id, t): a unit process run along the integral of a sampled rate (samples every ``period``)."""
    total = np.concatenate([[0.0], np.cumsum(np.asarray(rates, float) * period)])
    if np.min(rates) < 0:
        raise ValueError("rates must not be negative")

    def make(rng: np.random.Generator, _: int) -> np.ndarray:
        dead = p.get("refractory", 0.0)
        if kind == "poisson" and dead:
            t = _invert(_renewal(intervals_of("poisson", rng, 1.0), 1.0, 0.0, total[-1] * 1.5 + 10, True))
            keep, last = [], -np.inf
            for x in t:
                if x - last >= dead:
                    keep.append(x)
                    last = x
            return np.array(keep)
        extra = {k: v for k, v in p.items() if k != "refractory"}
        return _invert(_renewal(intervals_of(kind, rng, 1.0, **extra), 1.0, 0.0, total[-1], True))

    def _invert(u: np.ndarray) -> np.ndarray:
        u = u[u < total[-1]]
        return np.interp(u, total, np.arange(len(total)) * period)

    return _trains(spark, n, seed, make)


def single_interaction(spark: SparkSession, n: int, rate: float, coincidence_rate: float, stop: float, jitter: float = 0.0, deterministic: bool = True, seed: int = 0) -> DataFrame:
    """(train_id, t): independent Poisson trains that share jittered coincidences; each train keeps ``rate``."""
    if coincidence_rate > rate:
        raise ValueError("coincidences are more than events")

    def make(rng: np.random.Generator, _: int) -> np.ndarray:
        shared = np.random.default_rng([seed, 1 << 40])
        k = int(coincidence_rate * stop) if deterministic else shared.poisson(coincidence_rate * stop)
        c = np.sort(shared.uniform(0, stop, k)) + (rng.uniform(-jitter, jitter, k) if jitter else 0.0)
        own = rng.uniform(0, stop, rng.poisson((rate - coincidence_rate) * stop))
        t = np.concatenate([c, own])
        return np.sort(t[(t >= 0) & (t < stop)])

    return _trains(spark, n, seed, make)


def compound_poisson(spark: SparkSession, rate: float, amplitudes: list[float], stop: float, shift: float | None = None, seed: int = 0) -> DataFrame:
    """(train_id, t): a mother process whose events are copied into as many of the trains as ``amplitudes`` draws.

    ``amplitudes``: probabilities of 0..n trains. The mother is cut into time slices that are made in parallel."""
    a = np.asarray(amplitudes, float)
    if abs(a.sum() - 1) > 1e-8:
        raise ValueError("amplitudes must add up to 1")
    n = len(a) - 1
    mean = float(a @ np.arange(n + 1))
    mother = rate * n / mean if mean else 0.0
    slices = max(1, int(stop))

    def run(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            for s in pdf["id"]:
                rng = np.random.default_rng([seed, int(s)])
                lo, hi = stop * s / slices, stop * (s + 1) / slices
                t = rng.uniform(lo, hi, rng.poisson(mother * (hi - lo)))
                size = rng.choice(n + 1, len(t), p=a)
                order = rng.random((len(t), n)).argsort(axis=1)
                who, which = np.nonzero(np.arange(n)[None] < size[:, None])
                yield pd.DataFrame({"train_id": order[who, which].astype(np.int64), "t": t[who]})

    out = spark.range(0, slices, 1, min(slices, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(run, TRAIN)
    if shift:
        from pulseloom.plans.builders import uniform

        out = out.withColumn("t", F.col("t") + (2 * uniform(seed, F.col("train_id"), F.col("t")) - 1) * shift).where(F.col("t").between(0, stop))
    return out


def pool(a: DataFrame, b: DataFrame, inner: bool = True, start: float = 0.0, stop: float = float("inf")) -> DataFrame:
    """Two trains' events as one; inner leaves out the interval's ends."""
    both = a.select("t").unionByName(b.select("t"))
    return both.where((F.col("t") > start) & (F.col("t") < stop)) if inner else both


def autoregressive(spark: SparkSession, lags: list[list[list[float]]], length: int, seed: int = 0, recordings: int = 1, variances: list[float] | None = None) -> DataFrame:
    """(recording, channel, k, v): vector autoregressions with unit noise, one task for each recording."""
    a = np.asarray(lags, float)

    def run(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            for r in pdf["id"]:
                rng = np.random.default_rng([seed, int(r)])
                p, d = a.shape[0], a.shape[1]
                x = np.zeros((length + 100, d))
                noise = rng.standard_normal(x.shape) * np.sqrt(variances or np.ones(d))
                for k in range(len(x)):
                    x[k] = noise[k] + sum(a[q] @ x[k - q - 1] for q in range(min(p, k)))
                x = x[100:]
                yield pd.DataFrame({"recording": np.full(length * d, r, np.int64), "channel": np.tile(np.arange(d, dtype=np.int32), length), "k": np.repeat(np.arange(length), d), "v": x.ravel()})

    return spark.range(0, recordings, 1, recordings).mapInPandas(run, "recording long, channel int, k long, v double")


#: Two-channel process in which channel 1 drives channel 0.
PAIR = [[[0.9, 0.16], [0.0, 0.8]], [[-0.5, -0.2], [0.0, -0.5]]]
#: Three-channel process in which channel 1 drives channel 2, which drives channel 0; with a direct
#: effect of channel 1 on channel 0 at lag 2, or without one. Variances of its noise.
TRIPLE_LAG_1 = [[0.8, 0.0, 0.4], [0.0, 0.9, 0.0], [0.0, 0.5, 0.5]]
TRIPLE_LAG_2 = [[-0.5, 0.0, 0.0], [0.0, -0.8, 0.0], [0.0, 0.0, -0.2]]
TRIPLE_VARIANCES = [0.3, 1.0, 0.2]
DIRECT_EFFECT = 0.2


def driven_triple(spark: SparkSession, length: int = 30_000, direct: bool = False, seed: int = 0) -> DataFrame:
    """(recording, channel, k, v) of the three-channel process, for tests of conditional causality."""
    second = [list(row) for row in TRIPLE_LAG_2]
    second[0][1] = DIRECT_EFFECT if direct else 0.0
    return autoregressive(spark, [TRIPLE_LAG_1, second], length, seed, variances=TRIPLE_VARIANCES)


def homogeneous_poisson(spark: SparkSession, n: int, rate: float, start: float = 0.0, stop: float = 1.0, refractory: float = 0.0, seed: int = 0) -> DataFrame:
    """(train_id, t): n Poisson trains of one rate."""
    return stationary(spark, "poisson", n, rate, start, stop, seed=seed, refractory=refractory)


def inhomogeneous_poisson(spark: SparkSession, n: int, rates: list[float], period: float, refractory: float = 0.0, seed: int = 0) -> DataFrame:
    """(train_id, t): n Poisson trains of a sampled rate."""
    return modulated(spark, "poisson", n, rates, period, seed, refractory=refractory)


def homogeneous_gamma(spark: SparkSession, n: int, shape: float, scale_hz: float, start: float = 0.0, stop: float = 1.0, seed: int = 0) -> DataFrame:
    """(train_id, t): n gamma trains of a shape and a scale, whose rate is scale / shape."""
    return stationary(spark, "gamma", n, scale_hz / shape, start, stop, seed=seed, shape=shape)


def inhomogeneous_gamma(spark: SparkSession, n: int, rates: list[float], period: float, shape: float, seed: int = 0) -> DataFrame:
    """(train_id, t): n gamma trains of a sampled rate."""
    return modulated(spark, "gamma", n, rates, period, seed, shape=shape)
