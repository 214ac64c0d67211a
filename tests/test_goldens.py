"""Values that are known beforehand, by hand or by an independent computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions.kernels import NAMES, Kernel
from pulseloom.functions.units import hertz, is_time, micros
from pulseloom.operators import binning, complexity, correlation, distances, intervals, patterns, population, sequences, signals, spectral, surrogates, unitary

INTERVALS = [int(x) for x in (
    "1 28 4 47 5 16 2 5 21 12 4 12 59 2 4 18 33 25 2 34 4 1 1 14 8 1 10 1 8 20 5 1 6 5 12 2 8 8 2 8 2 10 2 1 1 2 15 3 20 6 11 6 18 2 5 17 4 3 13 6 "
    "1 18 1 16 12 2 52 2 5 7 6 25 6 5 3 15 4 3 16 3 6 5 24 21 3 3 4 8 4 11 5 7 5 6 8 11 33 10 7 4"
).split()]


def trains(spark, *times, stop=10_000_000):
    rows = [(k, int(round(t * 1e6))) for k, ts in enumerate(times) for t in ts]
    return spark.createDataFrame(rows, "train_id long, t_us long"), spark.createDataFrame([(k, 0, stop) for k in range(len(times))], "train_id long, t_start_us long, t_stop_us long")


def test_local_variation(spark):
    t = np.concatenate([[0], np.cumsum(INTERVALS)]) / 1000
    spikes, _ = trains(spark, t)
    r = intervals.local_variation(intervals.isi(spikes)).first()
    assert r.cv2 == pytest.approx(1.0022235296529176) and r.lv == pytest.approx(0.971826029994) and r.lvr == pytest.approx(2.1845363464753134)


def test_complexity(spark):
    a, b = [0.5, 0.7, 1.2, 2.3, 4.3, 5.5, 6.7], [0.5, 0.7, 1.2, 2.3, 4.3, 5.5, 8.0]
    binned = binning.Binned.of(*trains(spark, a, b, b), bin_us=100_000)
    assert [r.p for r in complexity.complexity_pdf(binned).orderBy("complexity").collect()] == pytest.approx([0.92, 0.01, 0.01, 0.06])
    grid = binning.Binned.of(*trains(spark, [1, 5, 9, 11, 16, 19], [1, 4, 8, 12, 16, 18], stop=20_000_000), bin_us=1_000_000)
    assert [r.n for r in complexity.complexity_histogram(grid).orderBy("complexity").collect()] == [10, 8, 2]


def test_tiling_and_covariance(spark):
    i, j = [1.3, 7.56, 15.87, 28.23, 30.9, 34.2, 38.2, 43.2], [1.02, 2.71, 18.82, 28.46, 28.79, 43.6]
    spikes, dim = trains(spark, [x / 1000 for x in i], [x / 1000 for x in j], stop=50_000)
    assert correlation.spike_time_tiling(spikes, 5_000, 0, 50_000).first().sttc == pytest.approx(0.495860165593)
    binned = binning.Binned.of(spikes, dim, bin_us=1_000)
    off = correlation.covariance(binned).where("i < j").collect()
    assert off and off[0].value == pytest.approx(0.06204081632653)


def test_waveforms(spark):
    w = [int(x) for x in "29 42 41 18 24 28 34 34 9 -31 -100 -145 -125 -88 -48 -18 14 36 30 33 -4 -25 -3 30 51 47 70 76 78 57 53 49 22 15 88 109 79 68".split()]
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(w)], "spike_id long, k int, v double")
    assert signals.waveform_width(df).first().width == 24
    df = spark.createDataFrame([(0, k, float(10 * s + k)) for s in range(2) for k in range(10)], "channel int, k int, v double")
    assert signals.waveform_snr(df).first().snr == pytest.approx(0.9)


def test_population(spark):
    t = np.array([0.4, 0.5, 0.65, 0.7, 0.9, 1.15, 1.2, 1.9])
    assert population.filter_value(t, 0.8, 0.5) == pytest.approx(-0.6572670690062)
    assert population.filter_value(t, 0.8, 0.25) == 0
    counts = spark.createDataFrame([(10,)] * 300 + [(0,)] * 99_700, "value long")
    order, p, _ = population.cubic(counts)
    assert order == 10 and p[-1] == pytest.approx(0.5381, abs=1e-4)


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = np.sort(rng.random(rng.integers(0, 9))), np.sort(rng.random(rng.integers(0, 9)))
        m = np.zeros((len(a) + 1, len(b) + 1))
        m[:, 0], m[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1, j + 1] = min(m[i, j + 1] + 1, m[i + 1, j] + 1, m[i, j] + 5 * abs(a[i] - b[j]))
        assert distances.edit_distance(a, b, 5.0) == pytest.approx(m[-1, -1])


def test_kernels():
    x = np.linspace(-40, 40, 80_001)
    for name in NAMES:
        k = Kernel(name, 1.5)
        y = np.array([k.pdf(v) for v in x[::8]])
        step = x[8] - x[0]
        assert y.sum() * step == pytest.approx(1, abs=2e-2)
        assert k.cdf(k.icdf(0.3)) == pytest.approx(0.3)
        assert sum(w for _, w in k.taps(0.01)) * 0.01 == pytest.approx(1, abs=2e-2)
    with pytest.raises(ValueError):
        Kernel("square", 1)


def test_units():
    assert micros(2, "ms") == 2000 and hertz(1, "kHz") == 1000 and is_time("s") and not is_time("Hz")
    with pytest.raises(ValueError):
        micros(1, "V")


def test_binning_resolves_and_round_trips(spark):
    spikes, dim = trains(spark, [0.5, 0.7, 1.2, 3.1, 4.3, 5.5, 6.7], [0.1, 0.7, 1.2, 2.2, 4.3, 5.5, 8.0], [])
    b = binning.Binned.of(spikes, dim, bin_us=1_000_000)
    assert (b.n_bins, b.totals().first().n, b.totals(1).where("train_id = 2").first().n) == (10, 14, 0)
    again = binning.Binned.of(b.to_spikes("left"), dim, bin_us=1_000_000)
    assert b.equals(again) and not b.equals(b.binarized())
    assert b.dense().count() == 30
    with pytest.raises(ValueError):
        binning.Binned.of(spikes, dim, bin_us=20_000_000)


def test_patterns_by_hand(spark):
    assert unitary.pattern_hash([1, 0, 1]) == 5 and unitary.pattern_of(5, 3) == [1, 0, 1]
    cells = spark.createDataFrame([(u, 10 * r + u) for r in range(5) for u in range(3)], "unit long, bin long")
    sets = patterns.drop_window_subsets(patterns.closed_sets(patterns.context(cells, 4), 4, 2, 5), 4).collect()
    assert [(list(s.itemset), s.support) for s in sets] == [([0, 5, 10], 5)]
    assert patterns.reduce_sets([{"itemset": [0, 1], "support": 5}, {"itemset": [0, 1, 2], "support": 5}]) == [{"itemset": [0, 1, 2], "support": 5}]


@pytest.mark.parametrize("hot", [200_000, 3])
def test_closed_sets_against_brute_force(spark, monkeypatch, hot):
    from itertools import combinations

    monkeypatch.setattr(patterns, "HOT_WINDOWS", hot)
    rng = np.random.default_rng(3)
    held = {w: sorted(set(rng.integers(0, 9, 5).tolist()) | ({0} if w % 3 else set())) for w in range(70)}
    items = spark.createDataFrame([(w, x) for w, xs in held.items() for x in xs], "window long, item long")
    want = {}
    for k in range(1, 10):
        for s in combinations(range(9), k):
            at = tuple(w for w, xs in held.items() if set(s) <= set(xs))
            if len(at) >= 2 and set.intersection(*(set(held[w]) for w in at)) == set(s):
                want[s] = at
    for least, most in ((1, None), (2, None), (2, 3)):
        found = {tuple(r.itemset): tuple(r.windows) for r in patterns.closed_sets(items, 1, least, 2, most).collect()}
        assert found == {s: at for s, at in want.items() if least <= len(s) <= (most or 9)}
    sets = patterns.closed_sets(items, 1, 2, 4)
    for r in patterns.stability(sets, items, 4000).collect():
        if r.support > 10:
            continue
        subsets = [c for k in range(r.support + 1) for c in combinations(r.windows, k)]
        same = sum(set.intersection(set(range(9)), *(set(held[w]) for w in c)) == set(r.itemset) for c in subsets) / len(subsets)
        parts = [c for k in range(len(r.itemset) + 1) for c in combinations(r.itemset, k)]
        beside = sum([w for w in held if set(c) <= set(held[w])] == list(r.windows) for c in parts) / len(parts)
        assert r.intensional == pytest.approx(same, abs=0.05) and r.extensional == pytest.approx(beside, abs=0.05)


def test_spade_keeps_what_surrogates_do_not_reach(spark):
    rng = np.random.default_rng(5)
    noise = [(u, int(b)) for u in range(5) for b in rng.choice(400, 25, replace=False)]
    cells = spark.createDataFrame(sorted({*noise, *((u, 20 * r + 3 + u) for r in range(12) for u in range(3))}), "unit long, bin long")
    drawn = [(k, u, int(b)) for k in range(20) for u in range(5) for b in rng.choice(400, 37 if u < 3 else 25, replace=False)]
    drawn = spark.createDataFrame(drawn, "surrogate int, unit long, bin long")
    for durations in (False, True):
        found = patterns.spade(cells, 4, drawn, 20, 0.05, durations=durations, min_support=3).collect()
        assert [0, 5, 10] in [list(r.itemset) for r in found] and len(found) <= 4
    stable = patterns.spade(cells, 4, n_subsets=200, stability_above=(0.9, 2.0), min_support=3).collect()
    assert [0, 5, 10] in [list(r.itemset) for r in stable]


def test_spectrum_and_corrections(spark):
    seen = [(0, [0, 1], 5), (0, [0, 1, 2], 7), (1, [0, 1], 4), (1, [0, 1], 6), (2, [0, 4], 3)]
    s = spark.createDataFrame([(k, x, n) for k, x, n in seen], "surrogate int, itemset array<long>, support long")
    assert sorted(tuple(r) for r in patterns.p_value_spectrum(s, 4).collect()) == [(2, 3, 0.75), (2, 6, 0.5), (2, 7, 0.25), (3, 7, 0.25)]
    p = [0.001, 0.012, 0.014, 0.019, 0.03, 0.2, 0.6]  # Hommel: four could all be true, so its level is 0.0125
    tests = spark.createDataFrame([(x,) for x in p], "p double")
    n = {m: patterns.rejected(tests, 0.05, m).where("significant").count() for m in patterns.CORRECTIONS}
    assert n == {"bonferroni": 1, "sidak": 1, "holm-sidak": 1, "holm": 1, "simes-hochberg": 1, "hommel": 2, "fdr_bh": 5, "fdr_by": 1, "fdr_tsbh": 5, "fdr_tsbky": 5, "none": 5}


def test_unitary_events_by_surrogates(spark):
    rng = np.random.default_rng(2)
    cells = sorted({(t, u + 1, int(b)) for t in range(6) for u in range(3) for b in rng.choice(20, 6 + u, replace=False)})
    cells = spark.createDataFrame([*cells, *[(t, u, 25) for t in range(6) for u in (1, 2)]], "trial_id long, unit long, bin long").distinct()
    out = {(r.window, r.pattern): r for r in unitary.window_analysis_by_surrogates(cells, 3, 40, 20, 10, [0b110, 0b111], 3000).collect()}
    assert sorted(out) == [(w, p) for w in range(3) for p in (6, 7)]
    assert out[0, 7].n_exp == pytest.approx(6 * 20 * 0.3 * 0.35 * 0.4, abs=0.2)
    assert out[0, 6].n_exp == pytest.approx(6 * 20 * 0.3 * 0.35 * 0.6, abs=0.2)
    # six trials in which both units have their one event of twenty bins at once
    assert out[2, 6].n_emp == 6 and out[2, 6].n_exp == pytest.approx(0.3, abs=0.05) and out[2, 6].p_value == 0
    assert out[2, 7].n_emp == 0 and out[2, 7].n_exp == 0 and out[2, 7].p_value == 1


def test_probability_matrix_by_surrogates(spark):
    x = spark.createDataFrame([(t, b) for t in range(3) for b in (1, 2)], "train_id long, bin long")
    drawn = [(s, t, b) for s in range(4) for t in range(3) for b in ((1, 2) if t <= s else (1, 5 + t))]
    imat = sequences.intersection_matrix(x)
    p = {(r.i, r.j): r.value for r in sequences.probability_matrix_by_surrogates(imat, spark.createDataFrame(drawn, "surrogate int, train_id long, bin long"), 4).collect()}
    assert p == {(1, 1): 0.5, (2, 2): 0.5, (1, 2): 0.5, (2, 1): 0.5}  # two of four surrogates have all three trains in both
    p = {(r.i, r.j): r.value for r in sequences.probability_matrix_by_surrogates(imat, spark.createDataFrame(drawn, "surrogate int, train_id long, bin long"), 4, False).collect()}
    assert p == {(1, 1): 0.0, (2, 2): 0.5, (1, 2): 0.5, (2, 1): 0.5}


def test_welch_options():
    t = np.arange(256)
    x = (3 * np.cos(2 * np.pi * 8 * t / 64) + 0.5 * t + 2)[None]
    for name in spectral.COSINES:
        f, s = spectral.cross_spectra(x, 1.0, 64, 0.5, None, taper=name, detrend="linear", scaling="spectrum")
        assert s[0, 0, 8].real == pytest.approx(3**2 / 2, rel=0.05)  # the power of a cosine
    assert spectral.cross_spectra(x - x + 0.5 * t, 1.0, 64, 0.5, None, detrend="linear")[1].real.max() < 1e-20
    f, s = spectral.cross_spectra(x, 1.0, 64, 0.5, None, nfft=128, detrend="linear")
    assert len(f) == 65 and f[np.argmax(s[0, 0].real)] == 0.125
    whole = spectral.cross_spectra(x, 1.0, 64, 0.5, None, detrend="linear")[1][0, 0].real
    assert s[0, 0].real.sum() / 128 == pytest.approx(whole.sum() / 64, rel=0.02)  # padding keeps the power


def test_coherence_takes_welch_options(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=256)
    both = [("x", c, k, float(v)) for c, x in enumerate((a, 3 * a + 0.2 * np.arange(256))) for k, v in enumerate(x)]
    samples = spark.createDataFrame(both, "recording string, channel int, k int, v double")
    lined = spectral.coherence(samples, detrend="linear", taper="blackman", nfft=128).toPandas()
    assert len(lined) == 65 and np.allclose(lined["coherence"], 1) and np.allclose(lined["phase_lag"], 0)
    assert spectral.coherence(samples, taper="boxcar").toPandas()["coherence"].min() < 0.99  # the line is still there


def test_order_survival():
    rng = np.random.default_rng(1)
    u = np.array([0.8, 0.6])
    draws = np.sort(rng.random((200_000, 5)), axis=1)[:, ::-1]
    assert sequences.order_survival(u, 5) == pytest.approx(((draws[:, 0] >= 0.8) & (draws[:, 1] >= 0.6)).mean(), abs=5e-3)


def test_surrogates_keep_counts(spark):
    spikes, _ = trains(spark, sorted(np.random.default_rng(0).random(50) * 10))
    for method, dt in (("randomise_spikes", None), ("shuffle_isis", None), ("jitter_spikes", 100_000)):
        s = surrogates.surrogates(spikes, method, 2, dt, 0, 10_000_000)
        assert s.groupBy("surrogate").count().select("count").distinct().first()[0] == 50
    shuffled = surrogates.shuffle_isis(spikes, 0).agg(F.max("t_us")).first()[0]
    assert shuffled == spikes.agg(F.max("t_us")).first()[0]
    with pytest.raises(ValueError):
        surrogates.surrogates(spikes, "dither_spikes")


def test_surrogates_by_train(spark):
    rng = np.random.default_rng(4)
    times = [np.cumsum(0.005 + rng.exponential(0.03, 200)), [1.0, 2.0], np.cumsum(0.005 + rng.exponential(0.03, 100))]
    stop = 20_000_000
    spikes, _ = trains(spark, *times, stop=stop)
    before = {k: np.array([round(x * 1e6) for x in ts]) for k, ts in enumerate(times)}

    def after(df):
        rows = df.toPandas().sort_values("t_us")
        return {k: g["t_us"].to_numpy() for k, g in rows.groupby(["surrogate", "train_id"])}

    moved = after(surrogates.dither_refractory(spikes, 15_000, 4_000, 0, stop, 2))
    for (_, k), t in moved.items():
        assert len(t) == len(before[k]) and np.abs(t - before[k]).max() <= 15_000 and np.diff(t).min() >= 4_000 and t[0] >= 0 and t[-1] <= stop
    assert (moved[0, 0] != moved[1, 0]).any() and (moved[0, 0] != before[0]).any()
    for method in ("joint_isi_dithering", "isi_dithering"):
        moved = after(surrogates.surrogates(spikes, method, 2, 15_000, 0, stop))
        for (_, k), t in moved.items():
            assert len(t) == len(before[k]) and t[0] == before[k][0] and abs(t[-1] - before[k][-1]) <= 1
            assert np.abs(t - before[k]).max() <= 2 * 15_000 + 1 and (len(t) < 3 or np.diff(t).min() >= 0)
        assert (moved[0, 1] == before[1]).all() and (moved[0, 0] != moved[1, 0]).any()
    whole = after(surrogates.joint_isi_dithering(spikes, window=False, alternate=False))
    assert len(whole[0, 0]) == 200 and np.diff(whole[0, 0]).min() >= 0
    counts = spikes.select("train_id", F.floor(F.col("t_us") / 100_000).cast("long").alias("bin")).groupBy("train_id", "bin").agg(F.count("*").alias("n"))
    filled = counts.groupBy("train_id").count().collect()
    slid = surrogates.bin_shuffling_sliding(counts, 5, 200).groupBy("train_id").count().collect()
    assert sorted(map(tuple, slid)) == sorted(map(tuple, filled))


def test_smoothing_keeps_mass():
    x = np.random.default_rng(0).random((30, 30))
    y = surrogates.smoothed(x, 2.0)
    assert y.shape == x.shape and y.sum() == pytest.approx(x.sum()) and y.std() < x.std()
    assert surrogates.smoothed(np.eye(1), 3.0) == pytest.approx(np.eye(1))


def test_parseval_and_filters():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1, 256))
    f, s = spectral.cross_spectra(x, 1.0, 256, 0.0, np.ones((1, 256)) / 16)
    assert len(f) == 129
    b, a = signals.butter_sections(2, None, 0.2, 1.0)
    assert b == pytest.approx([0.20657208, 0.41314417, 0.20657208]) and a == pytest.approx([1, -0.36952738, 0.19581571])
    t = np.arange(400)
    assert signals.filtfilt(*signals.butter_sections(4, None, 0.1, 1.0), np.cos(0.02 * np.pi * t))[100:300] == pytest.approx(np.cos(0.02 * np.pi * t)[100:300], abs=1e-2)


def test_executor(spark):
    from pulseloom.operators.parallel import SingleProcess, SparkExecutor

    assert SparkExecutor(spark).execute(abs, [-3, 2, -1]) == SingleProcess().execute(abs, [-3, 2, -1]) == [3, 2, 1]


def test_stream(spark, tmp_path):
    from pulseloom.sources.tables import table
    from pulseloom.streaming.counts import histogram

    events = table(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "in"))
    q = histogram(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hist").agg(F.sum("n")).first()[0] == events.count()


def test_normalized_cross_correlation_points_from_the_earlier_train(spark):
    spikes = spark.createDataFrame([(0, t * 1000) for t in (3, 4, 5)] + [(1, t * 1000) for t in (8, 9, 10)], "train_id int, t_us long")
    b = binning.Binned.of(spikes, spikes.select("train_id").distinct(), bin_us=1000, n_bins=20, t_start_us=0)
    got = {(r.i, r.j, r.delay): r.ncc for r in correlation.normalized_cross_correlation(b, (-5, 5)).collect()}
    assert got[0, 1, -5] == pytest.approx(1.1176470588) and got[1, 0, 5] == pytest.approx(1.1176470588)


def test_pairs_without_coincidence_have_values(spark):
    spikes = spark.createDataFrame([(0, 1_000), (1, 30_000)], "train_id int, t_us long")
    assert correlation.spike_time_tiling(spikes, 5_000, 0, 50_000).first().sttc == pytest.approx(-(0.12 + 0.2) / 2)
    b = binning.Binned.of(spikes, spikes.select("train_id").distinct(), bin_us=10_000, n_bins=5, t_start_us=0)
    assert {(r.i, r.j): r.value for r in correlation.covariance(b).collect()}[0, 1] == pytest.approx(-1 / 20)
    assert {(r.i, r.j): r.value for r in correlation.correlation(b).collect()}[0, 1] == pytest.approx(-0.25)


@pytest.mark.parametrize("spacing", [1.0, 1e-4])
def test_current_source_density_of_a_dipole(spark, spacing):
    from pulseloom.operators import density

    sources = [0.0] * 21
    sources[7], sources[9], sources[11] = -0.5, 1.0, -0.5
    matrix = np.zeros((21, 21))
    for k in range(21):
        matrix[k, k] = -1.0 if k in (0, 20) else -2.0
        if 0 < k < 20:
            matrix[k, k - 1] = matrix[k, k + 1] = 1.0
    potential = np.linalg.solve(matrix * -0.3 / spacing, sources)
    samples = spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(potential)], "channel int, k int, v double")
    got = {r.channel: r.csd for r in density.standard_csd(samples, spacing, edges=False).collect()}
    assert [got[k] for k in range(21)] == pytest.approx(sources, abs=1e-9)


def test_distances_against_their_definitions(spark):
    import math
    import random

    from pulseloom.operators import distances

    r = random.Random(3)
    trains = {k: sorted(r.randrange(10**6) for _ in range(r.randrange(1, 9))) for k in range(7)}
    trains[7] = trains[6]
    spikes = spark.createDataFrame([(k, t) for k, ts in trains.items() for t in ts], "train_id int, t_us long")
    distances.BLOCK, before = 3, distances.BLOCK

    def edit(a, b, q):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + q * abs(a[i - 1] - b[j - 1]) / 1e6)
        return d[-1][-1]

    s = lambda a, b: sum(math.exp(-abs(x - y) / 2e5) for x in a for y in b)
    pairs = [(i, j) for i in trains for j in trains if i < j]
    try:
        for found, want in (
            (distances.victor_purpura(spikes, 3.0), lambda a, b: edit(a, b, 3.0)), (distances.victor_purpura(spikes, math.inf), lambda a, b: len(a) + len(b)), (distances.victor_purpura(spikes, 0), lambda a, b: abs(len(a) - len(b))),
            (distances.van_rossum(spikes, 2e5), lambda a, b: math.sqrt(max(0, s(a, a) + s(b, b) - 2 * s(a, b)))),
        ):
            got = {(x.i, x.j): x.distance for x in found.collect()}
            assert sorted(got) == pairs
            assert [got[p] for p in pairs] == pytest.approx([want(trains[i], trains[j]) for i, j in pairs], abs=1e-6)
    finally:
        distances.BLOCK = before


def test_last_bin_goes_on_with_zeros(spark):
    samples = spark.createDataFrame([("a", k, 2.0) for k in range(5)], "channel string, k int, v double")
    assert {r.bin: r.area for r in signals.rauc(samples, None, 4).collect()} == {0: 6.0, 1: 1.0}


def test_spike_field_coherence(spark):
    from pulseloom.operators import spectral

    r = np.random.default_rng(5)
    counts = (r.random(2048) < 0.2).astype(float)
    v = np.convolve(counts, [0.5, 1.0, 0.5], "same") + 0.01 * r.standard_normal(2048)
    noise = r.standard_normal(2048)
    samples = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(v)] + [(1, k, float(x)) for k, x in enumerate(noise)], "channel int, k int, v double")
    spikes = spark.createDataFrame([(c, int(k)) for c in (0, 1) for k in np.flatnonzero(counts)], "channel int, k int")
    got = spectral.spike_field_coherence(samples, spikes).toPandas()
    assert got[(got.channel == 0) & (got.freq < 0.3)].coherence.min() > 0.9 and got[got.channel == 1].coherence.mean() < 0.25
    assert got[got.channel == 0].freq.tolist() == pytest.approx((np.arange(129) / 256).tolist())


def test_multitaper_cross_spectrum_is_the_plain_mean_of_tapers(spark):
    from pulseloom.operators import spectral

    x = np.random.default_rng(2).standard_normal((2, 64)) + 3
    tapers = spectral.dpss(64, 4.0, 7)
    f = np.fft.rfft(x[:, None] * tapers[None], axis=-1)
    want = (np.conj(f[0]) * f[1]).mean(axis=0)
    samples = spark.createDataFrame([(0, c, k, float(x[c, k])) for c in range(2) for k in range(64)], "recording int, channel int, k int, v double")
    got = spectral.multitaper_cross_spectrum(samples).where("i = 0 AND j = 1").orderBy("freq").toPandas()
    assert (got.re + 1j * got.im).to_numpy() == pytest.approx(want)


def test_small_helpers(spark):
    from pulseloom.functions import units
    from pulseloom.operators import causality, density, generators, latent, rates

    assert units.same_units(["ms", "ms"]) and not units.same_units(["ms", "s"])
    with pytest.raises(ValueError):
        units.same_units(["apples"])
    newer = units.renamed_arguments(binsize="bin_size")(lambda bin_size: bin_size)
    with pytest.warns(DeprecationWarning):
        assert newer(binsize=3) == 3
    assert rates.soft_log(rates.soft_exp(0.7)) == pytest.approx(0.7) and rates.soft_exp(200) == 200
    assert causality._rounded(0.1234, 2000) == 0.12
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (1, 1, 5.0)], "i int, j int, value double")
    assert sequences.is_symmetric(m) and not sequences.is_symmetric(m.where("i < j"))
    held = sequences.step_values(spark.createDataFrame([(0, 10, 1.0), (0, 20, 2.0)], "channel int, t_us long, v double"), spark.createDataFrame([(0, 5), (0, 10), (0, 19), (0, 30)], "channel int, t_us long"))
    assert [r.v for r in held.orderBy("t_us").collect()] == [1.0, 1.0, 1.0, 2.0]
    toeplitz = np.kron(np.exp(-np.abs(np.subtract.outer(range(5), range(5))) / 2), np.eye(2))
    inverse, logdet = latent.inverse_persymmetric(toeplitz, 2)
    assert inverse == pytest.approx(np.linalg.inv(toeplitz)) and logdet == pytest.approx(np.linalg.slogdet(toeplitz)[1])
    counts = spark.createDataFrame([(0, 1, b, 1) for b in range(10)] + [(1, 1, 0, 1)], "trial_id int, unit int, bin int, n int")
    parts = latent.cut_trials(counts, spark.createDataFrame([(0, 10), (1, 3)], "trial_id int, length int"), 4)
    assert sorted((r.segment_id, r.bin) for r in parts.collect()) == [(s, b) for s in range(3) for b in range(4)]
    assert density.dipole(np.array([0.5]))[0] == pytest.approx(0) and density.dipole(np.array([0.7]))[0] > 0
    z = np.arange(8) * 0.1
    samples = spark.createDataFrame([(c, 0, float(c * c)) for c in range(8)], "channel int, k int, v double")
    assert {r.channel: r.csd for r in density.estimate_csd(samples, z).collect()}[3] == pytest.approx(-0.3 * 2 / 0.1)
    assert all(density.estimate_csd(samples, z, m).count() == 8 for m in ("delta", "step", "spline", "kernel"))
    with pytest.raises(ValueError):
        density.estimate_csd(samples, z, "other")
    assert generators.homogeneous_poisson(spark, 20, 50.0, 0.0, 2.0).count() == pytest.approx(2000, rel=0.15)
    assert generators.homogeneous_gamma(spark, 20, 2.0, 100.0, 0.0, 2.0).count() == pytest.approx(2000, rel=0.15)
    triple = generators.driven_triple(spark, 500)
    assert triple.count() == 1500 and triple.select("channel").distinct().count() == 3


def test_surrogates_by_name(spark):
    spikes = spark.createDataFrame([(0, 1000 * k * k % 90_000) for k in range(1, 30)], "train_id int, t_us long").distinct()
    n = spikes.count()
    for method in ("bin_shuffling", "trial_shifting", "jitter_spikes"):
        out = surrogates.surrogates(spikes, method, 2, 10_000, 0, 100_000)
        assert out.columns == ["surrogate", "train_id", "t_us"] and 0.8 * 2 * n <= out.count() <= 2 * n


def test_long_tapers_take_memory_linear_in_their_length():
    import tracemalloc

    tracemalloc.start()
    got = spectral.dpss(2000, 4.0, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    want = spectral._dense_tapers(2001, 4.0, 7)[:, :-1]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-10
    assert got[0].sum() > 0 and got[1][0] > 0


@pytest.mark.parametrize("channels", [2, 1])
def test_multitaper_spectra_of_long_segments_take_little_memory(channels):
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(channels, 2500))
    tracemalloc.start()
    f, s = spectral.cross_spectra(x, 1.0, 1000 + channels, 0.5, spectral.dpss(1000 + channels, 4.0, 7), one_sided=channels == 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    dense = spectral._dense_tapers(1001 + channels, 4.0, 7)[:, :-1]
    assert np.allclose(s, spectral.cross_spectra(x, 1.0, 1000 + channels, 0.5, dense, one_sided=channels == 1)[1], atol=1e-9)


def test_cubic_of_counts_too_even_for_a_test(spark, tmp_path):
    from pulseloom.queries import QUERIES

    one = F.expr("TIMESTAMP '2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, cast(id % 720 as int))")
    spark.range(1440).select(F.col("id").alias("event_id"), one.alias("ts"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["cubic"](spark, str(tmp_path)).collect()] == [(None, None)]
    with pytest.raises(ValueError, match="less than the mean"):
        population.cubic(spark.createDataFrame([(k, 5) for k in range(9)], "bin int, value long"))


def peak_of(fn):
    import tracemalloc

    tracemalloc.start()
    try:
        out = fn()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_long_tapers_take_little_more_than_themselves():
    from pulseloom.operators import spectral

    spectral.dpss.cache_clear()
    tapers, peak = peak_of(lambda: spectral.dpss(200_000, 4.0, 7))
    spectral.dpss.cache_clear()
    assert peak < 3 * 7 * 200_000 * 8
    assert np.allclose(tapers**2, spectral._smooth_tapers(200_001, 4.0, 7)[:, :-1] ** 2, atol=1e-12)
    assert np.allclose(spectral._long_tapers(3001, 4.0, 7) ** 2, spectral._dense_tapers(3001, 4.0, 7) ** 2, atol=1e-10)


def test_cross_spectra_of_recordings_take_little_memory_and_pad_what_a_channel_lacks(spark):
    import pyarrow as pa

    from pulseloom.operators import spectral

    n = 100_000
    x, tapers = np.random.default_rng(2).normal(size=(2, n)), spectral.dpss(n, 4.0, 7)
    assert peak_of(lambda: spectral.cross_spectra(x, 1.0, n, 0.5, tapers, one_sided=False))[1] < 160 * n
    k = np.random.default_rng(3).permutation(2 * n)
    rows = pa.table({"channel": pa.array(k // n, pa.int32()), "k": pa.array(k % n), "v": pa.array(x[k // n, k % n])})
    (names, got), peak = peak_of(lambda: spectral._channels(rows))
    assert names == [0, 1] and (got == x).all() and peak < 120 * n
    part = pa.table({"channel": pa.array([7, 3, 7, 3], pa.int32()), "k": [2, 5, 1, 1], "v": [1.0, 2.0, 3.0, 4.0]})
    assert np.array_equal(spectral._channels(part)[1], [[4, np.nan, 2], [3, 1, np.nan]], equal_nan=True)
    with pytest.raises(ValueError, match="two values of one time"):
        spectral._channels(pa.table({"channel": pa.array([1, 1], pa.int32()), "k": [0, 0], "v": [1.0, 2.0]}))
