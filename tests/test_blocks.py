"""All-pair results by blocks of trains: against brute force over several blocks, and without pairs in a shuffle."""

import math
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import binning, correlation, distances, patterns
from pulseloom.plans import blocks


@pytest.fixture(autouse=True)
def several_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 2)
    monkeypatch.setattr(blocks, "BATCH", 7)


def counts_of(spark, names=None):
    rng = np.random.default_rng(5)
    x = rng.poisson(0.3, (12, 40)) * rng.integers(1, 3, (12, 1))
    x[4] = 0
    names = names or [f"t{k:02d}" for k in range(12)]
    kind = "string" if isinstance(names[0], str) else "long"
    cells = spark.createDataFrame([(names[i], int(t), int(x[i, t])) for i, t in zip(*np.nonzero(x), strict=True)], f"train_id {kind}, bin long, n long")
    return binning.Binned(cells, spark.createDataFrame([(n,) for n in names], f"train_id {kind}"), 1, 40), dict(zip(names, x, strict=True))


def unshuffled_pairs(df):
    """Whether the pairs that the groups make go to no exchange and no join."""
    above = df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    return "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString() and "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("kind", ["covariance", "correlation"])
def test_moments_of_all_pairs(spark, kind):
    b, x = counts_of(spark)
    df = getattr(correlation, kind)(b)
    assert unshuffled_pairs(df)
    got = {(r.i, r.j): r.value for r in df.collect()}
    assert set(got) == {(i, j) for i, j in product(x, x) if i <= j}
    for (i, j), v in got.items():
        c = np.cov(x[i], x[j])
        want = c[0, 1] if kind == "covariance" else c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]) if c[0, 0] * c[1, 1] else None
        assert v == pytest.approx(want) if want is not None else v is None


@pytest.mark.parametrize("names", [None, [5 * k - 20 for k in range(12)]])
def test_lagged_products(spark, names):
    b, x = counts_of(spark, names)
    df = correlation.cross_correlation_histogram(b, b, (-2, 3))
    assert unshuffled_pairs(df)
    want = {(i, j, k): v for i, j in product(x, x) for k in range(-2, 4) if (v := int(sum(x[i][t] * x[j][t + k] for t in range(40) if 0 <= t + k < 40)))}
    rows = df.collect()
    assert len(rows) == len(want) and {(r.i, r.j, r.lag): r.value for r in rows} == want
    rows = correlation.normalized_cross_correlation(b, (0, 2)).collect()
    assert {(r.i, r.j, r.delay) for r in rows} == {(i, j, d) for i, j in product(x, x) for d in range(3) if i != j and (i, j, -d) in want}
    sd = {i: v.std(ddof=1) for i, v in x.items()}
    assert all(r.ncc == pytest.approx(want[r.i, r.j, -r.delay] / (sd[r.i] * sd[r.j] * 40)) for r in rows)


def test_two_tables_meet(spark):
    (a, x), (b, y) = counts_of(spark), counts_of(spark, [f"u{k}" for k in range(12)])
    got = {(r.i, r.j, r.lag): r.value for r in correlation.cross_correlation_histogram(a, b, (0, 1)).collect()}
    assert got == {(i, j, k): v for i, j in product(x, y) for k in (0, 1) if (v := int(sum(x[i][t] * y[j][t + k] for t in range(40 - k))))}


def spikes_of(spark):
    rng = np.random.default_rng(8)
    trains = {f"t{k}": sorted(rng.integers(0, 100_000, rng.integers(1, 30)).tolist()) for k in range(11)}
    trains["t11"] = list(trains["t10"])
    return spark.createDataFrame([(i, t) for i, ts in trains.items() for t in ts], "train_id string, t_us long"), trains


def test_tiling_of_all_pairs(spark):
    spikes, trains = spikes_of(spark)
    df = correlation.spike_time_tiling(spikes, 2000, 0, 100_000)
    assert unshuffled_pairs(df)
    tiled = {i: len(set().union(*[range(max(0, t - 2000), min(100_000, t + 2000)) for t in ts])) / 100_000 for i, ts in trains.items()}
    hit = lambda i, j: np.mean([any(abs(t - u) <= 2000 + 1e-5 * u for u in trains[j]) for t in set(trains[i])])
    part = lambda p, t: 1.0 if p * t == 1 else (p - t) / (1 - p * t)
    got = {(r.i, r.j): r.sttc for r in df.collect()}
    assert set(got) == {(i, j) for i, j in product(trains, trains) if i < j}
    assert all(v == pytest.approx((part(hit(i, j), tiled[j]) + part(hit(j, i), tiled[i])) / 2) for (i, j), v in got.items())


@pytest.mark.parametrize("cost", [0.0, math.inf])
def test_distances_of_counts_shuffle_no_pairs(spark, cost):
    spikes, trains = spikes_of(spark)
    df = distances.victor_purpura(spikes, cost)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "Exchange" not in plan.split("Join")[0]
    want = {(i, j): abs(len(trains[i]) - len(trains[j])) if cost == 0 else len(trains[i]) + len(trains[j]) for i, j in product(trains, trains) if i < j}
    rows = df.collect()
    assert len(rows) == len(want) and {(r.i, r.j): r.distance for r in rows} == want


@pytest.mark.parametrize("tau", [50.0, 3000.0, 1e6])
def test_van_rossum_of_all_pairs(spark, tau):
    spikes, trains = spikes_of(spark)
    df = distances.van_rossum(spikes, tau)
    assert unshuffled_pairs(df)
    met = lambda i, j: np.exp(-np.abs(np.subtract.outer(trains[i], trains[j])) / tau).sum()
    got = {(r.i, r.j): r.distance for r in df.collect()}
    assert set(got) == {(i, j) for i, j in product(trains, trains) if i < j}
    assert all(v == pytest.approx(math.sqrt(max(0, met(i, i) + met(j, j) - 2 * met(i, j))), abs=1e-6) for (i, j), v in got.items())
    assert got["t10", "t11"] == 0


def test_edit_distances_of_many_trains_at_once(spark):
    spikes, trains = spikes_of(spark)
    got = {(r.i, r.j): r.distance for r in distances.victor_purpura(spikes, 700.0).collect()}
    assert all(v == pytest.approx(distances.edit_distance_plain([t / 1e6 for t in trains[i]], [t / 1e6 for t in trains[j]], 700.0)) for (i, j), v in got.items())
    many = np.array([[0.1, 0.2], [0.3, 0.0]])
    assert distances.edit_distances(np.array([0.1, 0.25]), many, np.array([2, 1]), 1.0).tolist() == pytest.approx([0.05, 1.05])


def test_coincidences_and_assemblies_of_all_pairs(spark):
    b, x = counts_of(spark)
    df = patterns.pair_coincidences(b.counts, 2)
    assert unshuffled_pairs(df)
    want = {(i, j, k): v for i, j in product(x, x) if i < j for k in range(-2, 3) if (v := int(sum(min(x[i][t], x[j][t + k]) for t in range(40) if 0 <= t + k < 40)))}
    rows = df.collect()
    assert len(rows) == len(want) and {(r.i, r.j, r.lag): r.n for r in rows} == want
    df = patterns.assembly_pairs(b.counts, 40, 2, 1e9, 3)
    assert unshuffled_pairs(df)
    best = {}
    for (i, j, k), n in want.items():
        best[i, j] = max(best.get((i, j), (0, 0, 0)), (n, -abs(k), -k))
    want = {ij: (-k, n, (n - (m := x[ij[0]].sum() * x[ij[1]].sum() / 40)) / math.sqrt(m)) for ij, (n, _, k) in best.items() if n >= 3}
    got = {(r.i, r.j): (r.lag, r.n, r.z) for r in df.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_closed_sets_are_not_stored_and_subsets_meet_no_join(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(int(u), int(t)) for u, t in zip(*np.nonzero(rng.random((9, 60)) < 0.3), strict=True)], "unit long, bin long")
    sets = patterns.closed_sets(patterns.context(cells, 3), 3, 2, 3)
    assert "ExistingRDD" not in sets._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    kept = patterns.drop_window_subsets(sets, 3)
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    rows = sets.collect()

    def ref(r):
        last = max(x % 3 for x in r.itemset)
        return {x // 3 * 3 + last - x % 3 for x in r.itemset}

    want = {tuple(r.itemset) for r in rows if not any(q.support == r.support and ref(r) < ref(q) for q in rows)}
    got = [tuple(r.itemset) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want and 0 < len(want) < len(rows)


def test_stability_meets_no_join_and_lots_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(int(u), int(t)) for u, t in zip(*np.nonzero(rng.random((9, 60)) < 0.35), strict=True)], "unit long, bin long")
    items = patterns.context(cells, 2)
    sets = patterns.closed_sets(items, 2, 2, 3)
    df = patterns.stability(sets, items, 100, 7)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    whole = {tuple(r.itemset): r for r in df.collect()}
    monkeypatch.setattr(patterns, "LOT_ROWS", 150)
    parted = {tuple(r.itemset): r for r in patterns.stability(sets, items, 100, 7).collect()}
    assert items.count() > 300 and len(whole) == sets.count() and whole == parted

    held = {}
    for r in items.collect():
        held.setdefault(r.window, set()).add(r.item)
    at = {}
    for w, xs in held.items():
        for x in xs:
            at.setdefault(x, set()).add(w)

    def share(things, own, holds, salt):  # of the same subsets
        drawn = patterns._drawn(np.array([things], np.int64), 100, 7, salt)[0].astype(bool)
        rest = set.union(*(holds[t] for t in things)) - set(own)
        return 1 - np.mean([bool(set.intersection(rest, *(holds[t] for t, on in zip(things, c, strict=True) if on))) for c in drawn.T])

    assert {len(r.windows) for r in whole.values()} >= {3, 4, 5, 8}
    for r in whole.values():
        assert r.intensional == pytest.approx(share(r.windows, r.itemset, held, 1)) and r.extensional == pytest.approx(share(r.itemset, r.windows, at, 2))


def test_spade_by_stability_alone_stores_no_sets(spark):
    cells = spark.createDataFrame([(u, 10 * r + u) for r in range(5) for u in range(3)], "unit long, bin long")
    df = patterns.spade(cells, 4, n_subsets=50, stability_above=(0.5, 0.5), min_support=5)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert [(list(r.itemset), r.support) for r in df.collect()] == [([0, 5, 10], 5)]


def test_blocks_travel_packed(spark):
    """What the pairs' exchange holds is a packed row for each of a block's pairs of blocks, not a row for each train."""
    b, x = counts_of(spark)
    df = correlation.covariance(b)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")
    assert "rows" in plan[1] and "bins" not in plan[1].split("Exchange")[0]
    rng = np.random.default_rng(9)
    cells = [np.unique(rng.integers(0, 720, 67)).tolist() for _ in range(1000)]
    rows = pa.table({"train_id": list(range(1000)), "bins": pa.array(cells, pa.list_(pa.int64())), "ns": pa.array([[1] * len(c) for c in cells], pa.list_(pa.int64()))})
    data = blocks.packed(rows)
    assert len(data) < rows.nbytes / 10 and blocks.unpacked(data).equals(rows)


@pytest.mark.parametrize("lists", [[[1, 5, 700], [], [-(2**63), 2**63 - 1, 0]], [[128, 256], [255], [127]], [[], [], []], [[1], None, [2]], [[1, None], [3], []]])
def test_packed_trains_come_back(lists):
    rows = pa.table({"train_id": ["a", "b", "c"], "bins": pa.array(lists, pa.list_(pa.int64())), "share": [0.1, None, 0.3]})
    for part in (rows, rows.slice(1), rows.slice(0, 0)):
        assert blocks.unpacked(blocks.packed(part)).equals(part)


def test_covariance_is_rounded_as_before(spark, tmp_path):
    """Small values go by a cheaper rounding, those of 64 and more by Spark's; both give Spark's."""
    from datetime import datetime, timedelta

    import __spark_entry__ as entry
    from pulseloom.queries import hourly

    rng = np.random.default_rng(3)
    events = [(u, datetime(2024, 1, 1) + timedelta(hours=int(h), minutes=5)) for u in range(8) for h in rng.integers(0, 720, 5 * 3**u // 9 + 1)]
    events += [(9, datetime(2024, 1, 3))] * 300
    spark.createDataFrame(events, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.i, r.j): r.value for r in entry.queries()["covariance"](spark, str(tmp_path)).collect()}
    want = {(r.i, r.j): r.value for r in correlation.covariance(hourly(spark, str(tmp_path))).withColumn("value", F.round("value", 9)).collect()}
    assert got == want and max(got.values()) > 64 and len(got) == 45


def test_only_significant_pairs_leave_their_task(spark, monkeypatch):
    b, x = counts_of(spark)
    made, real = [], patterns.block_pairs
    monkeypatch.setattr(patterns, "block_pairs", lambda *a: made.append(real(*a)) or made[-1])
    every = {(r.i, r.j): r for r in patterns.assembly_pairs(b.counts, 40, 2, 1e9, 1).collect()}
    pairs = 11 * 10 // 2 * 5
    for alpha in (1.0, 100.0):
        rows = patterns.assembly_pairs(b.counts, 40, 2, alpha, 1).collect()
        assert {(r.i, r.j): r for r in rows} == {k: r for k, r in every.items() if r.p <= alpha / pairs}
        assert made[-1].count() == len(rows)
    assert 0 < len(rows) < len(every) < made[0].count() + 1


def test_critical_counts():
    mean = np.array([[0.5, 3.0], [40.0, 800.0]])
    got = patterns._critical(mean, 1e-3)
    for m, n in zip(mean.ravel()[:3], got.ravel()[:3], strict=True):
        above = [1 - sum(math.exp(-m) * m**q / math.factorial(q) for q in range(k)) for k in (int(n) - 1, int(n))]
        assert above[0] > 1e-3 >= above[1]
    assert got[1, 1] == np.inf and (patterns._critical(mean, 1.0) == 0).all()  # exp(-800) is 0, as in poisson_tail


@pytest.mark.parametrize("per_pair", [0, 1e9])
def test_smaller_counts_are_summed_either_way(monkeypatch, per_pair):
    monkeypatch.setattr(correlation, "PER_PAIR", per_pair)
    rng = np.random.default_rng(6)
    x, y = rng.poisson(0.8, (6, 30)) * rng.integers(0, 4, (6, 1)), rng.poisson(1.1, (5, 30))
    side = lambda c: blocks.Side(pa.table({"train_id": list(range(len(c))), "bins": [np.flatnonzero(v).tolist() for v in c], "ns": [v[v > 0].tolist() for v in c]}))
    got = correlation.sums_of_products(side(x), side(y), [-1, 0, 2], least=True)(1, 6)
    for m, lag in zip(got, (-1, 0, 2), strict=True):
        assert m.tolist() == [[sum(min(int(a[t]), int(b[t + lag])) for t in range(30) if 0 <= t + lag < 30) for b in y] for a in x[1:6]]


def test_blocks_travel_to_lots(spark, monkeypatch):
    """A block goes to each lot of blocks once, not to each block, and a table that meets itself is dealt once."""
    monkeypatch.setattr(blocks, "BLOCK", 1)
    monkeypatch.setattr(blocks, "LEAST", 2)
    monkeypatch.setattr(blocks, "TASKS", 0)
    b, x = counts_of(spark)
    sent, real = [], blocks.F.inline
    monkeypatch.setattr(blocks.F, "inline", lambda c: sent.append(c) or real(c))
    got = {(r.i, r.j): r.value for r in correlation.covariance(b).collect()}
    assert set(got) == {(i, j) for i, j in product(x, x) if i <= j}
    assert all(v == pytest.approx(np.cov(x[i], x[j])[0, 1]) for (i, j), v in got.items())
    want = {(i, j, k): v for i, j in product(x, x) for k in range(-2, 4) if (v := int(sum(x[i][t] * x[j][t + k] for t in range(40) if 0 <= t + k < 40)))}
    df = correlation.cross_correlation_histogram(b, b, (-2, 3))
    rows = df.collect()
    assert len(rows) == len(want) and {(r.i, r.j, r.lag): r.value for r in rows} == want
    assert len(sent) == 2 and "Union" not in df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(blocks, "LEAST", 99)
    assert {(r.i, r.j): r.value for r in correlation.covariance(b).collect()} == got


def test_values_are_rounded_as_before(spark):
    """Values away from ties go by a cheaper rounding, the others by Spark's; both give Spark's."""
    from pulseloom.queries import rounded

    rng = np.random.default_rng(12)
    ties = (np.arange(-300, 300) + 0.5) / 1e9
    v = [*rng.uniform(-1, 1, 3000), *ties, *np.nextafter(ties, 1), *(ties * 1e3), 12345.6789012345, 1e300, float("inf"), float("nan"), 0.0, -0.0, -1e-12, None]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in v], "v double")
    for places in (6, 9):
        rows = df.select(rounded("v", places).cast("string").alias("a"), F.round("v", places).cast("string").alias("b")).collect()
        assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize("cost", [40.0, 700.0, 1e5])
def test_edit_distances_by_moves(monkeypatch, cost):
    """Only events near each other are tried; equal times, runs of near events and empty trains included."""
    rng = np.random.default_rng(13)
    trains = [sorted(rng.integers(0, 300_000, rng.integers(0, 40)).tolist()) for _ in range(14)] + [[], [5, 5, 5, 9], [5, 5, 9, 9], list(range(0, 90_000, 3000))]
    side = lambda ts: blocks.Side(pa.table({"train_id": list(range(len(ts))), "times": pa.array(ts, pa.list_(pa.int64()))}))
    one, two = trains[:9] + trains[13:], trains[4:]
    monkeypatch.setattr(distances, "PER_PAIR", 0)
    got = distances._moves(side(one), side(two), cost)(2, len(one))
    want = [[distances.edit_distance_plain([t / 1e6 for t in a], [t / 1e6 for t in b], cost) for b in two] for a in one[2:]]
    assert got == pytest.approx(np.array(want))
    monkeypatch.setattr(distances, "PER_PAIR", 1e9)
    assert distances._moves(side(one), side(two), cost) is None


def test_edit_distances_of_sparse_trains_need_few_moves():
    ts = [[100_000_000_000 * k + 1000 * u for k in range(20)] for u in range(30)]
    side = blocks.Side(pa.table({"train_id": list(range(30)), "times": pa.array(ts, pa.list_(pa.int64()))}))
    assert distances._moves(side, side, 1 / 7200)(0, 1)[0] == pytest.approx([20 * u * 1e-3 / 7200 for u in range(30)])
