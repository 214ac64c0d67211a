"""Registered queries of the event and signal operators, each with the SQL that must give the same rows.

Float results are rounded alike in both; sums of integers stay integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.kernels import NAMES, Kernel
from pulseloom.operators import binning, complexity, correlation, distances, intervals, rates, signals, surrogates, unitary
from pulseloom.sources.tables import DAY_US, SPAN_US, event_trains, table, trains_of, unit_trains, user_signal, vector_signals

HOUR = 3_600_000_000
HOURS = 720

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---- common parts of the SQL ----

SPIKES = "spikes AS (SELECT user_id AS train_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us FROM events), trains AS (SELECT DISTINCT train_id FROM spikes)"
BINNED = f"""{SPIKES}, binned AS (SELECT train_id, bin, count(*) AS n FROM (SELECT train_id, t_us // {HOUR} + CASE WHEN t_us % {HOUR} >= {HOUR} * (1 - 1e-8) THEN 1 ELSE 0 END AS bin FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US}) WHERE bin < {HOURS} GROUP BY ALL)"""
ISI = f"""{SPIKES}, isi AS (SELECT * FROM (SELECT train_id, row_number() OVER w - 2 AS i, t_us - lag(t_us) OVER w AS isi_us FROM spikes WINDOW w AS (PARTITION BY train_id ORDER BY t_us)) WHERE isi_us IS NOT NULL)"""
UNITS = f"""units AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {DAY_US} AS trial_id, event_type AS train_id,
list_position(['click','error','purchase','signup','view'], event_type) AS unit, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % {DAY_US} AS t_us FROM events)"""
SAMPLES = "samples AS (SELECT label AS trial_id, vec_id AS k, unnest(range(0, {n})) AS channel, unnest(embedding[1:{n}])::DOUBLE AS v FROM embeddings)"
VALUES_ = "vals AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value AS v FROM events)"


def query(name: str, sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def rounded(name: str, places: int) -> Column:
    """F.round of a double: where it is not near a tie or large, by a cheaper way that gives the same."""
    v, x = F.col(name), F.col(name) * float(10**places)
    sure = (F.abs(x) < 4e9) & (F.abs(x - F.floor(x) - 0.5) > 2e-6)
    return F.when(sure, F.rint(x) / float(10**places) + 0.0).otherwise(F.round(v, places))


def hourly(spark: SparkSession, sf: str) -> binning.Binned:
    spikes = event_trains(spark, sf)
    return binning.Binned.of(spikes, trains_of(spikes), bin_us=HOUR, n_bins=HOURS, t_start_us=0)


def minutes(spark: SparkSession, sf: str, width_us: int) -> binning.Binned:
    spikes = event_trains(spark, sf)
    return binning.Binned.of(spikes, trains_of(spikes), bin_us=width_us, n_bins=SPAN_US // width_us, t_start_us=0)


def unit_cells(spark: SparkSession, sf: str, width_us: int = HOUR) -> DataFrame:
    return unit_trains(spark, sf).select("trial_id", "unit", F.floor(F.col("t_us") / width_us).cast("long").alias("bin")).distinct()


# ---- binning ----


@query("time_histogram", f"WITH {BINNED} SELECT h.bin, coalesce(sum(n), 0)::BIGINT AS value FROM range(0, {HOURS}) AS h(bin) LEFT JOIN binned USING (bin) GROUP BY h.bin")
def _(spark, sf):
    return rates.time_histogram(hourly(spark, sf))


@query("time_histogram_rate", f"WITH {BINNED} SELECT h.bin, round(coalesce(count(n), 0) / (SELECT count(*) FROM trains) / 3600.0, 9) AS value FROM range(0, {HOURS}) AS h(bin) LEFT JOIN binned USING (bin) GROUP BY h.bin")
def _(spark, sf):
    return rates.time_histogram(hourly(spark, sf), "rate", True).withColumn("value", F.round("value", 9))


@query("bin_counts", f"WITH {BINNED} SELECT train_id, bin, n FROM binned")
def _(spark, sf):
    return hourly(spark, sf).counts


@query("bin_edges", f"SELECT range AS bin, range * {HOUR} AS edge_us FROM range(0, {HOURS + 1})")
def _(spark, sf):
    return hourly(spark, sf).edges()


@query("bin_centers", f"SELECT range AS bin, range * {HOUR} + {HOUR} / 2 AS center_us FROM range(0, {HOURS})")
def _(spark, sf):
    return hourly(spark, sf).centers()


@query("bin_dense", f"WITH {BINNED} SELECT t.train_id, h.bin, coalesce(n, 0) AS n FROM trains t CROSS JOIN range(0, {HOURS}) AS h(bin) LEFT JOIN binned USING (train_id, bin)")
def _(spark, sf):
    return hourly(spark, sf).dense()


@query("bin_dense_bool", f"WITH {BINNED} SELECT t.train_id, h.bin, coalesce(n, 0) > 0 AS active FROM trains t CROSS JOIN range(0, {HOURS}) AS h(bin) LEFT JOIN binned USING (train_id, bin)")
def _(spark, sf):
    return hourly(spark, sf).dense_bool()


@query("bin_sparse_bool", f"WITH {BINNED} SELECT train_id, bin, true AS active FROM binned")
def _(spark, sf):
    return hourly(spark, sf).sparse_bool()


@query("bin_clipped", f"WITH {BINNED} SELECT train_id, bin, 1::BIGINT AS n FROM binned")
def _(spark, sf):
    return hourly(spark, sf).binarized().counts


@query("bin_total", f"WITH {BINNED} SELECT sum(n)::BIGINT AS n FROM binned")
def _(spark, sf):
    return hourly(spark, sf).totals()


@query("bin_train_totals", f"WITH {BINNED} SELECT train_id, coalesce(sum(n), 0)::BIGINT AS n FROM trains LEFT JOIN binned USING (train_id) GROUP BY train_id")
def _(spark, sf):
    return hourly(spark, sf).totals(1)


@query("bin_indices", f"WITH {BINNED} SELECT train_id, bin FROM (SELECT train_id, bin, unnest(range(0, n)) FROM binned)")
def _(spark, sf):
    return hourly(spark, sf).indices()


@query("bin_is_binary", f"WITH {BINNED} SELECT max(n) <= 1 AS is_binary FROM binned")
def _(spark, sf):
    return hourly(spark, sf).is_binary()


@query("bin_sparsity", f"WITH {BINNED} SELECT round(count(*) / ((SELECT count(*) FROM trains) * {HOURS}), 9) AS sparsity FROM binned")
def _(spark, sf):
    return hourly(spark, sf).sparsity().select(F.round("sparsity", 9).alias("sparsity"))


@query("bin_time_slice", f"WITH {BINNED} SELECT train_id, bin - 48 AS bin, n FROM binned WHERE bin >= 48 AND bin < 168")
def _(spark, sf):
    return hourly(spark, sf).time_slice(2 * DAY_US, 7 * DAY_US).counts


@query("bin_strided", f"WITH {BINNED} SELECT train_id, (bin - 10) // 3 AS bin, n FROM binned WHERE bin >= 10 AND bin < 700 AND (bin - 10) % 3 = 0 AND train_id IN (1, 2, 3, 5, 8)")
def _(spark, sf):
    return hourly(spark, sf).take(10, 700, 3, [1, 2, 3, 5, 8]).counts


@query("bin_set_cells", f"WITH {BINNED}, new AS (SELECT train_id, 5::BIGINT AS bin, 7::BIGINT AS n FROM trains WHERE train_id < 10) SELECT train_id, bin, coalesce(new.n, binned.n) AS n FROM binned FULL JOIN new USING (train_id, bin)")
def _(spark, sf):
    b = hourly(spark, sf)
    cells = b.trains.where("train_id < 10").select("train_id", F.lit(5).cast("long").alias("bin"), F.lit(7).cast("long").alias("n"))
    return b.with_cells(cells).counts


@query("bin_equal", "SELECT true AS same, false AS clipped_same")
def _(spark, sf):
    b, wide = hourly(spark, sf), minutes(spark, sf, DAY_US)
    same, other = b.equals(hourly(spark, sf)), wide.equals(wide.binarized())
    return spark.range(1).select(F.lit(same).alias("same"), F.lit(other).alias("clipped_same"))


for _place, _expr in (("left", "k::DOUBLE / n"), ("center", "(k + 1)::DOUBLE / (n + 1)"), ("random", "('0x' || substr(md5('3:' || train_id || ':' || bin || ':' || k), 1, 8))::BIGINT / 4294967296.0")):

    @query(f"bin_to_spikes_{_place}", f"WITH {BINNED} SELECT train_id, bin, (bin * {HOUR} + floor(({_expr}) * {HOUR}))::BIGINT AS t_us FROM (SELECT train_id, bin, n, unnest(range(0, n)) AS k FROM binned)")
    def _(spark, sf, place=_place):
        return hourly(spark, sf).to_spikes(place, 3)


@query("binarize", f"""WITH {SPIKES}, hit AS (SELECT DISTINCT train_id, least(floor(t_us / {6 * HOUR}.0 + 0.5), 120)::BIGINT AS k FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US})
SELECT t.train_id, g.k, hit.k IS NOT NULL AS active FROM trains t CROSS JOIN range(0, 121) AS g(k) LEFT JOIN hit USING (train_id, k)""")
def _(spark, sf):
    spikes = event_trains(spark, sf)
    return binning.binarize(spikes, trains_of(spikes), 6 * HOUR, 0, SPAN_US)


@query("discretise", f"WITH {SPIKES} SELECT train_id, t_us // 60000000 * 60000000 AS t_us FROM spikes")
def _(spark, sf):
    return binning.discretise(event_trains(spark, sf), 60_000_000)


@query("common_interval", f"SELECT 0::BIGINT AS t_start_us, {SPAN_US}::BIGINT AS t_stop_us, true AS consistent")
def _(spark, sf):
    t = trains_of(event_trains(spark, sf))
    a, b = binning.common_interval(t)
    return spark.range(1).select(F.lit(a).cast("long").alias("t_start_us"), F.lit(b).cast("long").alias("t_stop_us"), F.lit(binning.check_consistency(t)).alias("consistent"))


# ---- trials ----


@query("trial_counts", f"WITH {UNITS} SELECT trial_id::INT AS trial_id, count(DISTINCT train_id) AS n_trains, count(*) AS n_spikes FROM units GROUP BY 1")
def _(spark, sf):
    return unit_trains(spark, sf).groupBy("trial_id").agg(F.countDistinct("train_id").alias("n_trains"), F.count("*").alias("n_spikes"))


@query("trial_subset", f"WITH {UNITS} SELECT trial_id::INT AS trial_id, train_id, t_us FROM units WHERE trial_id IN (0, 3, 7)")
def _(spark, sf):
    from pulseloom.operators.trials import Trials

    return Trials(unit_trains(spark, sf)).take([0, 3, 7]).rows.select("trial_id", "train_id", "t_us")


# ---- intervals ----


@query("isi", f"WITH {ISI} SELECT train_id, i, isi_us FROM isi")
def _(spark, sf):
    return intervals.isi(event_trains(spark, sf))


@query("mean_firing_rate", f"WITH {SPIKES} SELECT train_id, round(count(CASE WHEN t_us BETWEEN {DAY_US} AND {11 * DAY_US} THEN 1 END) * 1e6 / {10 * DAY_US}, 12) AS rate_hz FROM spikes GROUP BY 1")
def _(spark, sf):
    spikes = event_trains(spark, sf)
    return intervals.mean_firing_rate(spikes, trains_of(spikes), DAY_US, 11 * DAY_US).withColumn("rate_hz", F.round("rate_hz", 12))


@query("fanofactor", f"WITH {UNITS}, c AS (SELECT train_id, trial_id, count(*) AS n FROM units GROUP BY ALL), g AS (SELECT t.train_id, r.trial_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT train_id FROM units) t CROSS JOIN range(0, 30) AS r(trial_id) LEFT JOIN c USING (train_id, trial_id)) SELECT train_id, round(var_pop(n) / avg(n), 6) AS fano FROM g GROUP BY 1")
def _(spark, sf):
    u = unit_trains(spark, sf)
    n = u.groupBy("train_id", F.col("trial_id").cast("long").alias("trial_id")).agg(F.count("*").alias("n"))
    grid = u.select("train_id").distinct().withColumn("trial_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    full = grid.join(n, ["train_id", "trial_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return intervals.fanofactor(full, ["train_id"]).withColumn("fano", F.round("fano", 6))


@query("cv", f"WITH {ISI} SELECT train_id, round(stddev_pop(isi_us) / avg(isi_us), 6) AS cv FROM isi GROUP BY 1")
def _(spark, sf):
    return intervals.cv(intervals.isi(event_trains(spark, sf))).withColumn("cv", F.round("cv", 6))


@query("local_variation", f"""WITH {ISI}, p AS (SELECT train_id, isi_us::DOUBLE AS a, (lead(isi_us) OVER (PARTITION BY train_id ORDER BY i))::DOUBLE AS b FROM isi)
SELECT train_id, round(2 * avg(abs(a - b) / (a + b)), 6) AS cv2, round(3 * avg(pow((a - b) / (a + b), 2)), 6) AS lv, round(3 * avg((1 - 4 * a * b / ((a + b) * (a + b))) * (1 + 4 * 5000 / (a + b))), 6) AS lvr FROM p WHERE b IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    out = intervals.local_variation(intervals.isi(event_trains(spark, sf)))
    return out.select("train_id", *[F.round(c, 6).alias(c) for c in ("cv2", "lv", "lvr")])


# ---- rates and kernels ----

_G = Kernel("gaussian", 2 * 3600.0)


def _taps_sql(kernel: Kernel, cutoff: float = 3.0) -> str:
    return ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in kernel.taps(3600.0, cutoff) if w > 0)


@query("instantaneous_rate", f"""WITH {SPIKES}, h AS (SELECT train_id, least(t_us // {HOUR}, {HOURS - 1}) AS bin, count(*) AS n FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US} GROUP BY ALL),
taps(o, w) AS (VALUES {_taps_sql(_G)}), s AS (SELECT train_id, bin + o AS bin, sum(n * w) AS r FROM h CROSS JOIN taps WHERE bin + o BETWEEN 0 AND {HOURS - 1} GROUP BY ALL)
SELECT t.train_id, g.bin, round(coalesce(r, 0.0), 9) AS rate_hz FROM trains t CROSS JOIN range(0, {HOURS}) AS g(bin) LEFT JOIN s USING (train_id, bin)""")
def _(spark, sf):
    spikes = event_trains(spark, sf)
    return rates.instantaneous_rate(spikes, trains_of(spikes), HOUR, _G, 0, SPAN_US, cutoff=3.0).withColumn("rate_hz", F.round("rate_hz", 9))


@query("instantaneous_rate_pooled", f"""WITH {SPIKES}, h AS (SELECT train_id, least(t_us // {HOUR}, {HOURS - 1}) AS bin, count(*) AS n FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US} GROUP BY ALL),
taps(o, w) AS (VALUES {_taps_sql(_G)}), s AS (SELECT bin + o AS bin, sum(n * w) AS r FROM h CROSS JOIN taps GROUP BY ALL),
area AS (SELECT g.b AS bin, 3600.0 * sum(w) AS a FROM range(0, {HOURS}) AS g(b), taps WHERE g.b - o BETWEEN 0 AND {HOURS - 1} GROUP BY ALL)
SELECT area.bin, round(coalesce(r, 0.0) / a / (SELECT count(*) FROM trains), 9) AS rate_hz FROM area LEFT JOIN s USING (bin)""")
def _(spark, sf):
    spikes = event_trains(spark, sf)
    return rates.instantaneous_rate(spikes, trains_of(spikes), HOUR, _G, 0, SPAN_US, cutoff=3.0, border_correction=True, pool=True).withColumn("rate_hz", F.round("rate_hz", 9))


_DENSITY = {
    "rectangular": "CASE WHEN abs(t) < sqrt(3) THEN 1 / (2 * sqrt(3)) ELSE 0 END", "triangular": "greatest(0, (1 - abs(t) / sqrt(6)) / sqrt(6))", "epanechnikov": "greatest(0, 0.75 / sqrt(5) * (1 - t * t / 5))",
    "gaussian": "exp(-0.5 * t * t) / sqrt(2 * pi())", "laplacian": "exp(-sqrt(2) * abs(t)) / sqrt(2)", "exponential": "CASE WHEN t >= 0 THEN exp(-t) ELSE 0 END", "alpha": "CASE WHEN t >= 0 THEN 2 * t * exp(-sqrt(2) * t) ELSE 0 END",
}
for _name in NAMES:

    @query(f"kernel_{_name}", f"SELECT event_id, round({_DENSITY[_name]}, 9) AS density FROM (SELECT event_id, value / 50.0 - 1.0 AS t FROM events)")
    def _(spark, sf, name=_name):
        return table(spark, sf, "events").select("event_id", F.round(Kernel(name, 1.0).density(F.col("value") / 50.0 - 1.0), 9).alias("density"))


@query("optimal_bandwidth")
def _(spark, sf):
    return rates.optimal_bandwidth(event_trains(spark, sf))


# ---- complexity and synchrony ----


@query("complexity_histogram", f"WITH {BINNED}, c AS (SELECT bin, count(*) AS complexity FROM binned GROUP BY bin) SELECT complexity, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 0, {HOURS} - count(*) FROM c")
def _(spark, sf):
    return complexity.complexity_histogram(hourly(spark, sf))


@query("complexity_pdf", f"WITH {BINNED}, c AS (SELECT bin, count(*) AS complexity FROM binned GROUP BY bin), h AS (SELECT complexity, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 0, {HOURS} - count(*) FROM c) SELECT complexity, round(n / (SELECT sum(n) FROM h), 9) AS p FROM h")
def _(spark, sf):
    return complexity.complexity_pdf(hourly(spark, sf)).withColumn("p", F.round("p", 9))


_TENTH = HOUR // 10
BINNED6 = f"""{SPIKES}, binned AS (SELECT train_id, bin, count(*) AS n FROM (SELECT train_id, t_us // {_TENTH} + CASE WHEN t_us % {_TENTH} >= {_TENTH} * (1 - 1e-8) THEN 1 ELSE 0 END AS bin FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US}) WHERE bin < 7200 GROUP BY ALL)"""
_EPOCHS = f"""{BINNED6}, c AS (SELECT bin, count(*) AS x FROM binned GROUP BY bin), m AS (SELECT bin, x, CASE WHEN bin - lag(bin) OVER (ORDER BY bin) <= 1 THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT bin, x, sum(new) OVER (ORDER BY bin) AS epoch FROM m), e AS (SELECT epoch::BIGINT AS epoch, min(bin) AS first_bin, max(bin) AS last_bin, sum(x)::BIGINT AS complexity FROM i GROUP BY 1)"""


@query("complexity_epochs", f"WITH {_EPOCHS} SELECT epoch, first_bin, last_bin, complexity FROM e")
def _(spark, sf):
    return complexity.epochs(minutes(spark, sf, _TENTH), True, 1)


@query("annotate_synchrony", f"WITH {_EPOCHS}, s AS (SELECT train_id, t_us, t_us // {_TENTH} + CASE WHEN t_us % {_TENTH} >= {_TENTH} * (1 - 1e-8) THEN 1 ELSE 0 END AS bin FROM spikes) SELECT train_id, t_us, complexity FROM s JOIN e ON s.bin BETWEEN first_bin AND last_bin")
def _(spark, sf):
    return complexity.annotate_synchrony(event_trains(spark, sf), minutes(spark, sf, _TENTH), 1)


@query("delete_synchrony", f"WITH {_EPOCHS}, s AS (SELECT train_id, t_us, t_us // {_TENTH} + CASE WHEN t_us % {_TENTH} >= {_TENTH} * (1 - 1e-8) THEN 1 ELSE 0 END AS bin FROM spikes) SELECT train_id, t_us, complexity FROM s JOIN e ON s.bin BETWEEN first_bin AND last_bin WHERE complexity < 3")
def _(spark, sf):
    return complexity.delete_synchrony(complexity.annotate_synchrony(event_trains(spark, sf), minutes(spark, sf, _TENTH), 1), 3)


_SCALES = complexity.scales(SPAN_US, 6 * HOUR)


_CONTRAST = f"""{SPIKES}, w AS (SELECT unnest([{', '.join(map(str, _SCALES))}])::BIGINT AS width_us), i AS (SELECT coalesce(min(gap), 0) AS least, (SELECT count(*) FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US}) AS events FROM (SELECT t_us - lag(t_us) OVER (PARTITION BY train_id ORDER BY t_us) AS gap FROM spikes WHERE t_us BETWEEN 0 AND {SPAN_US})),
x AS (SELECT train_id, width_us, ceil(({SPAN_US} + 2 * least) / (width_us / 2))::BIGINT - 2 AS last, floor((t_us + least) / (width_us / 2))::BIGINT AS s FROM spikes, w, i WHERE t_us BETWEEN 0 AND {SPAN_US}),
y AS (SELECT train_id, width_us, last, unnest([least(s, last + 1) - 1, least(s, last + 1)]) AS bin FROM x), d AS (SELECT width_us, bin, count(*) AS theta, count(DISTINCT train_id) AS n FROM y WHERE bin BETWEEN 0 AND last GROUP BY ALL),
g AS (SELECT width_us, unnest(range(0, ceil(({SPAN_US} + 2 * least) / (width_us / 2))::BIGINT - 1)) AS bin FROM w, i), f AS (SELECT width_us, bin, coalesce(theta, 0) AS theta, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (width_us, bin)),
j AS (SELECT *, abs(theta - lag(theta) OVER (PARTITION BY width_us ORDER BY bin)) AS step FROM f), p AS (SELECT width_us, coalesce(sum(step), 0) / (2 * (SELECT events FROM i)) AS contrast, (sum(n * theta) / sum(theta) - 1) / ((SELECT count(*) FROM trains) - 1) AS active FROM j GROUP BY 1)"""


@query("spike_contrast", f"WITH {_CONTRAST} SELECT width_us, round(contrast, 9) AS contrast, round(active, 9) AS active, round(contrast * active, 9) AS synchrony FROM p")
def _(spark, sf):
    spikes = event_trains(spark, sf)
    out = complexity.spike_contrast(spikes, trains_of(spikes).count(), SPAN_US, _SCALES)
    return out.select("width_us", *[F.round(c, 9).alias(c) for c in ("contrast", "active", "synchrony")])


@query("spike_contrast_synchrony", f"WITH {_CONTRAST} SELECT round(max(contrast * active), 9) AS synchrony FROM p")
def _(spark, sf):
    spikes = event_trains(spark, sf)
    return complexity.synchrony(complexity.spike_contrast(spikes, trains_of(spikes).count(), SPAN_US, _SCALES)).select(F.round("synchrony", 9).alias("synchrony"))


# ---- correlation ----

_MOMENTS = "m AS (SELECT train_id, coalesce(sum(n), 0)::BIGINT AS s, coalesce(sum(n * n), 0)::BIGINT AS q FROM trains LEFT JOIN binned USING (train_id) GROUP BY 1), xy AS (SELECT a.train_id AS i, b.train_id AS j, sum(a.n * b.n)::BIGINT AS sxy FROM binned a JOIN binned b ON a.bin = b.bin AND a.train_id <= b.train_id GROUP BY ALL)"


@query("covariance", f"WITH {BINNED}, {_MOMENTS} SELECT a.train_id AS i, b.train_id AS j, round((coalesce(sxy, 0) - a.s * b.s / {HOURS}) / {HOURS - 1}, 9) AS value FROM m a JOIN m b ON a.train_id <= b.train_id LEFT JOIN xy ON xy.i = a.train_id AND xy.j = b.train_id")
def _(spark, sf):
    v = F.col("value")  # no covariance of counts below 64 is near a tie of the ninth place, where both ways to round differ; the first is the cheaper
    return correlation.covariance(hourly(spark, sf)).withColumn("value", F.when(F.abs(v) < 64, F.rint(v * 1e9) / 1e9).otherwise(F.round(v, 9)))


@query("correlation_coefficient", f"WITH {BINNED}, {_MOMENTS} SELECT a.train_id AS i, b.train_id AS j, round((coalesce(sxy, 0) - a.s * b.s / {HOURS}) / (sqrt(a.q - a.s * a.s / {HOURS}) * sqrt(b.q - b.s * b.s / {HOURS})), 9) AS value FROM m a JOIN m b ON a.train_id <= b.train_id LEFT JOIN xy ON xy.i = a.train_id AND xy.j = b.train_id")
def _(spark, sf):
    return correlation.correlation(hourly(spark, sf)).withColumn("value", rounded("value", 9))


@query("cross_correlation_histogram", f"WITH {BINNED} SELECT a.train_id AS i, b.train_id AS j, b.bin - a.bin AS lag, sum(a.n * b.n)::BIGINT AS value FROM binned a JOIN binned b ON b.bin BETWEEN a.bin - 5 AND a.bin + 5 GROUP BY ALL")
def _(spark, sf):
    b = hourly(spark, sf)
    return correlation.cross_correlation_histogram(b, b, (-5, 5))


@query("cross_correlation_coefficient", f"""WITH {BINNED}, m AS (SELECT train_id, sum(n)::BIGINT AS s, sum(n * n)::BIGINT AS q FROM binned GROUP BY 1), c AS (SELECT a.train_id AS i, b.train_id AS j, b.bin - a.bin AS lag, sum(a.n * b.n) * {HOURS} / ({HOURS} - abs(b.bin - a.bin)) AS v FROM binned a JOIN binned b ON b.bin BETWEEN a.bin - 5 AND a.bin + 5 GROUP BY a.train_id, b.train_id, b.bin - a.bin)
SELECT a.train_id AS i, b.train_id AS j, l.lag, round((coalesce(v, 0) - a.s * b.s / {HOURS}) / sqrt((a.q - a.s * a.s / {HOURS}) * (b.q - b.s * b.s / {HOURS})), 9) AS value FROM m a CROSS JOIN m b CROSS JOIN range(-5, 6) AS l(lag) LEFT JOIN c ON c.i = a.train_id AND c.j = b.train_id AND c.lag = l.lag""")
def _(spark, sf):
    b = hourly(spark, sf)
    return correlation.cross_correlation_histogram(b, b, (-5, 5), border_correction=True, coefficient=True).withColumn("value", F.round("value", 9))


_DT = 600_000_000
_REACH = _DT + SPAN_US // 100_000 + 1


@query("spike_time_tiling", f"""WITH {SPIKES}, g AS (SELECT train_id, t_us, lead(t_us) OVER w AS nx, lag(t_us) OVER w AS pv FROM spikes WINDOW w AS (PARTITION BY train_id ORDER BY t_us)),
ta AS (SELECT train_id, sum(CASE WHEN nx IS NULL THEN least({_DT}, {SPAN_US} - t_us) ELSE least(nx - t_us, {2 * _DT}) END + CASE WHEN pv IS NULL THEN least({_DT}, t_us) ELSE 0 END) / {SPAN_US} AS share FROM g GROUP BY 1),
h AS (SELECT a.train_id AS i, b.train_id AS j, count(DISTINCT a.t_us) AS hits FROM spikes a JOIN spikes b ON b.t_us BETWEEN a.t_us - {_REACH} AND a.t_us + {_REACH} AND abs(a.t_us - b.t_us) <= {_DT}::DOUBLE + 1e-5::DOUBLE * abs(b.t_us) AND a.train_id <> b.train_id GROUP BY ALL), n AS (SELECT train_id, count(DISTINCT t_us) AS n FROM spikes GROUP BY 1),
p AS (SELECT i, j, hits / n AS share FROM h JOIN n ON i = train_id)
SELECT ta.train_id AS i, tb.train_id AS j, round(((coalesce(x.share, 0) - tb.share) / (1 - coalesce(x.share, 0) * tb.share) + (coalesce(y.share, 0) - ta.share) / (1 - coalesce(y.share, 0) * ta.share)) / 2, 9) AS sttc FROM ta JOIN ta tb ON ta.train_id < tb.train_id LEFT JOIN p x ON x.i = ta.train_id AND x.j = tb.train_id LEFT JOIN p y ON y.i = tb.train_id AND y.j = ta.train_id""")
def _(spark, sf):
    return correlation.spike_time_tiling(event_trains(spark, sf), _DT, 0, SPAN_US).withColumn("sttc", rounded("sttc", 9))


@query("spike_train_timescale", f"""WITH {BINNED}, m AS (SELECT train_id, sum(n)::BIGINT AS s, sum(n * n)::BIGINT AS q FROM binned GROUP BY 1), c AS (SELECT a.train_id, b.bin - a.bin AS lag, sum(a.n * b.n) AS c FROM binned a JOIN binned b ON a.train_id = b.train_id AND b.bin BETWEEN a.bin AND a.bin + 24 GROUP BY ALL)
SELECT m.train_id, round(2 * sum(CASE WHEN l.lag IN (0, 24) THEN 0.5 ELSE 1 END * pow((coalesce(c, 0) - s * s / {HOURS}) / (q - s * s / {HOURS}), 2)), 6) AS tau_bins FROM m CROSS JOIN range(0, 25) AS l(lag) LEFT JOIN c ON c.train_id = m.train_id AND c.lag = l.lag WHERE s >= 2 GROUP BY 1""")
def _(spark, sf):
    return correlation.timescale(hourly(spark, sf), 24).withColumn("tau_bins", F.round("tau_bins", 6))


@query("normalized_cross_correlation", f"""WITH {BINNED}, m AS (SELECT train_id, sqrt((sum(n * n) - sum(n) * sum(n) / {HOURS}) / {HOURS - 1}) AS sd FROM binned GROUP BY 1)
SELECT a.train_id AS i, b.train_id AS j, a.bin - b.bin AS delay, round(sum(a.n * b.n) / (any_value(x.sd) * any_value(y.sd) * {HOURS}), 9) AS ncc FROM binned a JOIN binned b ON a.bin BETWEEN b.bin AND b.bin + 3 AND a.train_id <> b.train_id JOIN m x ON x.train_id = a.train_id JOIN m y ON y.train_id = b.train_id GROUP BY a.train_id, b.train_id, a.bin - b.bin""")
def _(spark, sf):
    return correlation.normalized_cross_correlation(hourly(spark, sf), (0, 3)).withColumn("ncc", rounded("ncc", 9))


@query("total_spiking_probability_edges")
def _(spark, sf):
    u = unit_trains(spark, sf).select("train_id", (F.col("t_us") + F.col("trial_id") * DAY_US).alias("t_us"))
    b = binning.Binned.of(u, trains_of(u), bin_us=HOUR, n_bins=HOURS, t_start_us=0)
    return correlation.total_spiking_probability_edges(b)


# ---- distances ----

_FEW = f"{SPIKES}, few AS (SELECT train_id, t_us FROM spikes), c AS (SELECT train_id, count(*) AS n FROM few GROUP BY 1)"


def few(spark: SparkSession, sf: str) -> DataFrame:
    return event_trains(spark, sf)


@query("victor_purpura_zero", f"WITH {_FEW} SELECT a.train_id AS i, b.train_id AS j, abs(a.n - b.n)::DOUBLE AS distance FROM c a JOIN c b ON a.train_id < b.train_id")
def _(spark, sf):
    return distances.victor_purpura(few(spark, sf), 0.0)


@query("victor_purpura_infinite", f"WITH {_FEW} SELECT a.train_id AS i, b.train_id AS j, (a.n + b.n)::DOUBLE AS distance FROM c a JOIN c b ON a.train_id < b.train_id")
def _(spark, sf):
    return distances.victor_purpura(few(spark, sf), float("inf"))


@query("victor_purpura")
def _(spark, sf):
    return distances.victor_purpura(few(spark, sf), 1 / 7200).withColumn("distance", rounded("distance", 6))


@query("van_rossum", f"""WITH {_FEW}, d AS (SELECT a.train_id AS i, b.train_id AS j, sum(exp(-abs(a.t_us - b.t_us) / {HOUR}.0)) AS d FROM few a JOIN few b ON b.t_us BETWEEN a.t_us - {40 * HOUR} AND a.t_us + {40 * HOUR} GROUP BY ALL)
SELECT a.train_id AS i, b.train_id AS j, round(sqrt(greatest(x.d + y.d - 2 * coalesce(z.d, 0), 0)), 6) AS distance FROM c a JOIN c b ON a.train_id < b.train_id JOIN d x ON x.i = a.train_id AND x.j = a.train_id JOIN d y ON y.i = b.train_id AND y.j = b.train_id LEFT JOIN d z ON z.i = a.train_id AND z.j = b.train_id""")
def _(spark, sf):
    return distances.van_rossum(few(spark, sf), float(HOUR)).withColumn("distance", rounded("distance", 6))


# ---- unitary events ----

_CELLS = f"{UNITS}, cells AS (SELECT DISTINCT trial_id, unit, t_us // {HOUR} AS bin FROM units), hashed AS (SELECT trial_id, bin, sum(1 << (5 - unit))::BIGINT AS hash FROM cells GROUP BY ALL)"


@query("pattern_hashes", f"WITH {_CELLS} SELECT trial_id::INT AS trial_id, bin, hash FROM hashed")
def _(spark, sf):
    return unitary.hashes(unit_cells(spark, sf), 5, ["trial_id"])


@query("pattern_counts", f"WITH {_CELLS} SELECT trial_id::INT AS trial_id, count(*) AS n_emp FROM hashed WHERE hash = 31 GROUP BY 1")
def _(spark, sf):
    return unitary.empirical(unitary.hashes(unit_cells(spark, sf), 5, ["trial_id"]), 31, ["trial_id"]).select("trial_id", "n_emp")


_P = "SELECT trial_id, unit, count(*) / 24 AS p FROM cells GROUP BY ALL"


@query("pattern_expected", f"WITH {_CELLS}, p AS ({_P}), f AS (SELECT t.trial_id, u.unit, coalesce(p, 0.0) AS p FROM (SELECT DISTINCT trial_id FROM cells) t CROSS JOIN range(1, 6) AS u(unit) LEFT JOIN p USING (trial_id, unit)) SELECT trial_id::INT AS trial_id, round(24 * product(CASE WHEN unit IN (1, 3) THEN p ELSE 1 - p END), 6) AS n_exp FROM f GROUP BY 1")
def _(spark, sf):
    cells = unit_cells(spark, sf)
    return unitary.expected(cells, cells.select("trial_id").distinct(), 5, 24, 0b10100, ["trial_id"]).withColumn("n_exp", F.round("n_exp", 6))


@query("joint_surprise_windows")
def _(spark, sf):
    cells = unit_cells(spark, sf, HOUR // 4)
    out = unitary.window_analysis(cells, cells.select("trial_id").distinct(), 5, 96, 16, 4, 0b10100)
    return out.select("window", "n_emp", *[F.round(c, 6).alias(c) for c in ("n_exp", "p_value", "surprise")])


@query("unitary_surrogate_windows")
def _(spark, sf):
    return unitary.window_analysis_by_surrogates(unit_cells(spark, sf, HOUR // 4), 5, 96, 16, 4, [0b10100, 0b11000], 200)


# ---- signals ----


@query("zscore", f"WITH {VALUES_}, m AS (SELECT channel, avg(v) AS a, stddev_pop(v) AS s FROM vals GROUP BY 1) SELECT channel, k, round(CASE WHEN s > 0 THEN (v - a) / s ELSE 0 END, 6) AS v FROM vals JOIN m USING (channel)")
def _(spark, sf):
    return signals.zscore(user_signal(spark, sf)).select("channel", "k", F.round("v", 6).alias("v"))


@query("signal_cross_correlation", f"WITH {SAMPLES.format(n=64)}, m AS (SELECT channel, avg(v) AS a, stddev_pop(v) AS s, count(*) AS n FROM samples GROUP BY 1), z AS (SELECT channel, k, n, (v - a) / s AS v FROM samples JOIN m USING (channel)) SELECT a.channel::INT AS i, b.channel::INT AS j, b.k - a.k AS lag, round(sum(a.v * b.v) / (any_value(a.n) - abs(b.k - a.k)), 6) AS value FROM z a JOIN z b ON b.k BETWEEN a.k - 3 AND a.k + 3 WHERE a.channel % 2 = 0 AND b.channel = a.channel + 1 GROUP BY a.channel, b.channel, b.k - a.k")
def _(spark, sf):
    return signals.cross_correlation(vector_signals(spark, sf), [(c, c + 1) for c in range(0, 64, 2)], 3).withColumn("value", F.round("value", 6))


@query("rauc", f"WITH {VALUES_}, m AS (SELECT channel, avg(v) AS a FROM vals GROUP BY 1), x AS (SELECT channel, k, k // 10 AS bin, abs(v - a) AS v, count(*) OVER (PARTITION BY channel, k // 10) AS many FROM vals JOIN m USING (channel)), p AS (SELECT channel, bin, (v + coalesce(lead(v) OVER (PARTITION BY channel, bin ORDER BY k), CASE WHEN many < 10 THEN 0 END)) / 2 AS t FROM x) SELECT channel, bin, round(coalesce(sum(t), 0), 6) AS area FROM p GROUP BY ALL")
def _(spark, sf):
    return signals.rauc(user_signal(spark, sf), "mean", 10).withColumn("area", F.round("area", 6))


@query("derivative", f"WITH {VALUES_}, d AS (SELECT channel, k, (lead(v) OVER (PARTITION BY channel ORDER BY k) - v) AS dv FROM vals) SELECT channel, k, round(dv, 6) AS dv FROM d WHERE dv IS NOT NULL")
def _(spark, sf):
    return signals.derivative(user_signal(spark, sf)).withColumn("dv", F.round("dv", 6))


_RUNS = f"{VALUES_}, b AS (SELECT channel, k, v, k - row_number() OVER (PARTITION BY channel ORDER BY k) AS run FROM vals WHERE v > 60)"


@query("threshold_detection", f"WITH {_RUNS} SELECT channel, min(k) AS k FROM b GROUP BY channel, run")
def _(spark, sf):
    return signals.threshold_detection(user_signal(spark, sf), 60.0)


@query("peak_detection", f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, run ORDER BY v DESC, k) AS o FROM b) SELECT channel, k, v FROM r WHERE o = 1")
def _(spark, sf):
    return signals.peak_detection(user_signal(spark, sf), 60.0)


@query("spike_extraction", f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, run ORDER BY v DESC, k) AS o FROM b), e AS (SELECT channel, max(k) AS hi FROM vals GROUP BY 1) SELECT r.channel, r.k AS event, (s.k - r.k)::INT AS \"offset\", s.v FROM r JOIN e ON e.channel = r.channel JOIN vals s ON s.channel = r.channel AND s.k BETWEEN r.k - 2 AND r.k + 3 WHERE o = 1 AND r.k - 2 >= 0 AND r.k + 3 <= hi")
def _(spark, sf):
    x = user_signal(spark, sf)
    return signals.snippets(x, signals.peak_detection(x, 60.0), 2, 4)


@query("spike_triggered_average", f"WITH {SAMPLES.format(n=64)}, e AS (SELECT event_id % 64 AS channel, (event_id * 7) % 500 AS k FROM events), h AS (SELECT max(k) AS hi FROM samples) SELECT s.channel::INT AS channel, (s.k - e.k)::INT AS \"offset\", round(avg(s.v), 6) AS mean, count(*) AS used FROM e JOIN samples s ON s.channel = e.channel AND s.k BETWEEN e.k - 5 AND e.k + 4, h WHERE e.k - 5 >= 0 AND e.k + 4 <= hi GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 64).cast("int").alias("channel"), (F.col("event_id") * 7 % 500).alias("k"))
    return signals.spike_triggered_average(vector_signals(spark, sf), e, 5, 5).withColumn("mean", F.round("mean", 6))


@query("waveform_width", "WITH w AS (SELECT vec_id AS spike_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), t AS (SELECT spike_id, k, row_number() OVER (PARTITION BY spike_id ORDER BY v, k) AS o FROM w WHERE k < 48), p AS (SELECT w.spike_id, w.k, t.k AS trough, row_number() OVER (PARTITION BY w.spike_id ORDER BY v DESC, w.k) AS o FROM w JOIN t ON t.spike_id = w.spike_id AND t.o = 1 AND w.k >= t.k) SELECT spike_id, (k - trough)::INT AS width FROM p WHERE o = 1")
def _(spark, sf):
    w = vector_signals(spark, sf).select(F.col("k").alias("spike_id"), F.col("channel").alias("k"), "v")
    return signals.waveform_width(w)


@query("waveform_snr", "WITH w AS (SELECT label AS channel, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT channel, k, avg(v) AS m, stddev_pop(v) AS sd FROM w GROUP BY ALL) SELECT channel, round((max(m) - min(m)) / (2 * avg(sd)), 6) AS snr FROM s GROUP BY 1")
def _(spark, sf):
    w = vector_signals(spark, sf).select(F.col("trial_id").alias("channel"), F.col("channel").alias("k"), "v")
    return signals.waveform_snr(w).withColumn("snr", F.round("snr", 6))


@query("mean_phase_vector", f"WITH {UNITS} SELECT train_id, round(atan2(avg(sin(2 * pi() * t_us / {DAY_US})), avg(cos(2 * pi() * t_us / {DAY_US}))), 6) AS angle, round(sqrt(pow(avg(cos(2 * pi() * t_us / {DAY_US})), 2) + pow(avg(sin(2 * pi() * t_us / {DAY_US})), 2)), 6) AS length FROM units GROUP BY 1")
def _(spark, sf):
    p = unit_trains(spark, sf).select("train_id", (F.lit(2.0) * F.pi() * F.col("t_us") / DAY_US).alias("phase"))
    return signals.mean_phase(p, ["train_id"]).select("train_id", F.round("angle", 6).alias("angle"), F.round("length", 6).alias("length"))


@query("phase_difference", "SELECT event_id, round(atan2(sin(value / 10 - user_id), cos(value / 10 - user_id)), 6) AS d FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(signals.phase_difference(F.col("value") / 10, F.col("user_id").cast("double")), 6).alias("d"))


@query("phase_locking_value", f"WITH {SAMPLES.format(n=64)}, p AS (SELECT a.trial_id, a.channel // 2 AS k, a.v * 3 - b.v * 3 AS d FROM samples a JOIN samples b ON a.k = b.k AND b.channel = a.channel + 1 WHERE a.channel % 2 = 0) SELECT k::BIGINT AS k, round(sqrt(pow(avg(cos(d)), 2) + pow(avg(sin(d)), 2)), 6) AS plv FROM p GROUP BY 1")
def _(spark, sf):
    x = vector_signals(spark, sf)
    pair = x.groupBy("trial_id", F.col("k").alias("rep"), F.floor(F.col("channel") / 2).cast("long").alias("k")).agg(F.max(F.when(F.col("channel") % 2 == 0, F.col("v") * 3)).alias("a"), F.max(F.when(F.col("channel") % 2 == 1, F.col("v") * 3)).alias("b"))
    return signals.phase_locking(pair).withColumn("plv", F.round("plv", 6))


@query("spike_triggered_phase", f"WITH {SAMPLES.format(n=64)}, a AS (SELECT channel // 2 AS channel, k, max(CASE WHEN channel % 2 = 0 THEN v END) AS re, max(CASE WHEN channel % 2 = 1 THEN v END) AS im FROM samples GROUP BY ALL), e AS (SELECT event_id, event_id % 32 AS channel, (event_id % 4500) / 10.0 + 0.25 AS t FROM events) SELECT event_id, round(atan2(im, re), 6) AS phase, round(sqrt(re * re + im * im), 6) AS amplitude FROM e JOIN a ON a.channel = e.channel AND a.k = floor(e.t)")
def _(spark, sf):
    part = lambda odd: F.max(F.when(F.col("channel") % 2 == odd, F.col("v")))
    x = vector_signals(spark, sf).groupBy("k", F.floor(F.col("channel") / 2).cast("int").alias("pair")).agg(part(0).alias("re"), part(1).alias("im")).withColumnRenamed("pair", "channel")
    e = table(spark, sf, "events").select((F.col("event_id") % 32).cast("int").alias("channel"), (F.col("event_id") % 4500 / 10.0 + 0.25).alias("t"), "event_id")
    found = signals.spike_phase(x, e.select("channel", "t").distinct(), 1.0)
    return e.join(found, ["channel", "t"]).select("event_id", F.round("phase", 6).alias("phase"), F.round("amplitude", 6).alias("amplitude"))


@query("hilbert")
def _(spark, sf):
    return signals.hilbert(vector_signals(spark, sf))


@query("butter")
def _(spark, sf):
    return signals.butter(vector_signals(spark, sf), 0.05, 0.2)


@query("wavelet")
def _(spark, sf):
    return signals.wavelet(vector_signals(spark, sf), [0.05, 0.1, 0.2])


# ---- surrogates ----

_COPIES = f"{SPIKES}, c AS (SELECT train_id, t_us, row_number() OVER (PARTITION BY train_id, s ORDER BY t_us) AS i, s AS surrogate FROM spikes CROSS JOIN range(0, 2) AS r(s))"
_U = "(('0x' || substr(md5('0:' || surrogate || ':' || train_id || ':' || i), 1, 8))::BIGINT / 4294967296.0)"
_UT = _U.replace(" || ':' || i", "")


@query("surrogate_dither_spikes", f"WITH {_COPIES}, d AS (SELECT surrogate::INT AS surrogate, train_id, (t_us + floor((2 * {_U} - 1) * {HOUR}))::BIGINT AS t_us FROM c) SELECT * FROM d WHERE t_us > 0 AND t_us < {SPAN_US}")
def _(spark, sf):
    return surrogates.dither_spikes(event_trains(spark, sf), HOUR, 0, SPAN_US, 2)


@query("surrogate_randomise", f"WITH {_COPIES} SELECT surrogate::INT AS surrogate, train_id, floor({_U} * {SPAN_US})::BIGINT AS t_us FROM c")
def _(spark, sf):
    return surrogates.randomise_spikes(event_trains(spark, sf), 0, SPAN_US, 2)


@query("surrogate_shuffle_isis", f"WITH {_COPIES}, g AS (SELECT surrogate, train_id, i, t_us - coalesce(lag(t_us) OVER (PARTITION BY surrogate, train_id ORDER BY i), 0) AS gap, {_U} AS u FROM c) SELECT surrogate::INT AS surrogate, train_id, (sum(gap) OVER (PARTITION BY surrogate, train_id ORDER BY u, i))::BIGINT AS t_us FROM g")
def _(spark, sf):
    return surrogates.shuffle_isis(event_trains(spark, sf), 0, 2)


@query("surrogate_dither_train", f"WITH {_COPIES}, d AS (SELECT surrogate::INT AS surrogate, train_id, (t_us + floor((2 * {_UT} - 1) * {HOUR}))::BIGINT AS t_us FROM c) SELECT * FROM d WHERE t_us >= 0 AND t_us < {SPAN_US}")
def _(spark, sf):
    return surrogates.dither_train(event_trains(spark, sf), HOUR, 0, SPAN_US, 2)


@query("surrogate_jitter", f"WITH {_COPIES} SELECT surrogate::INT AS surrogate, train_id, (t_us // {HOUR} * {HOUR} + floor({_U} * {HOUR}))::BIGINT AS t_us FROM c")
def _(spark, sf):
    return surrogates.jitter_spikes(event_trains(spark, sf), HOUR, 2)


@query("surrogate_bin_shuffling")
def _(spark, sf):
    return surrogates.bin_shuffling(hourly(spark, sf).counts, 12, 2)


@query("surrogate_trial_shifting", f"WITH {UNITS}, c AS (SELECT trial_id, train_id, t_us, s AS surrogate FROM units CROSS JOIN range(0, 2) AS r(s)), d AS (SELECT surrogate, trial_id, train_id, (t_us + floor((2 * (('0x' || substr(md5('0:' || surrogate || ':' || trial_id || ':' || train_id), 1, 8))::BIGINT / 4294967296.0) - 1) * {2 * HOUR}))::BIGINT AS x FROM c) SELECT surrogate::INT AS surrogate, trial_id::INT AS trial_id, train_id, (x % {DAY_US} + {DAY_US}) % {DAY_US} AS t_us FROM d")
def _(spark, sf):
    return surrogates.trial_shifting(unit_trains(spark, sf), 2 * HOUR, DAY_US, 2)


@query("surrogate_dither_refractory")
def _(spark, sf):
    return surrogates.dither_refractory(event_trains(spark, sf), HOUR, HOUR // 60, 0, SPAN_US, 2)


@query("surrogate_bin_shuffling_continuous", f"WITH {_COPIES}, e AS (SELECT surrogate, train_id, t_us // {HOUR} // 12 AS w, t_us // {HOUR} % 12 AS slot, {_U} AS u FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY surrogate, train_id, w ORDER BY ('0x' || substr(md5('0:' || surrogate || ':' || train_id || ':' || w || ':' || slot), 1, 8))::BIGINT, slot) - 1 AS to_slot FROM (SELECT DISTINCT surrogate, train_id, w FROM e), range(0, 12) AS r(slot)), d AS (SELECT surrogate::INT AS surrogate, train_id, ((w * 12 + to_slot) * {HOUR} + floor(u * {HOUR}))::BIGINT AS t_us FROM e JOIN p USING (surrogate, train_id, w, slot)) SELECT * FROM d WHERE t_us > 0 AND t_us < {SPAN_US}")
def _(spark, sf):
    return surrogates.bin_shuffling_continuous(event_trains(spark, sf), HOUR, 12, 0, SPAN_US, 2)


@query("surrogate_bin_shuffling_sliding")
def _(spark, sf):
    return surrogates.bin_shuffling_sliding(hourly(spark, sf).counts, 12, HOURS, 2)


@query("surrogate_trial_shifting_of_one", f"WITH {_COPIES}, e AS (SELECT surrogate, train_id, t_us // {DAY_US} AS trial, t_us % {DAY_US} AS t FROM c), d AS (SELECT surrogate, train_id, trial, (t + floor((2 * (('0x' || substr(md5('0:' || surrogate || ':' || trial || ':' || train_id), 1, 8))::BIGINT / 4294967296.0) - 1) * {2 * HOUR}))::BIGINT AS x FROM e WHERE t <= {20 * HOUR} AND trial < {SPAN_US // DAY_US}) SELECT surrogate::INT AS surrogate, train_id, (x % {20 * HOUR} + {20 * HOUR}) % {20 * HOUR} + trial * {DAY_US} AS t_us FROM d")
def _(spark, sf):
    return surrogates.shift_trials_of_one(event_trains(spark, sf), 2 * HOUR, 20 * HOUR, 4 * HOUR, 0, SPAN_US, 2)


@query("surrogate_joint_isi")
def _(spark, sf):
    return surrogates.joint_isi_dithering(event_trains(spark, sf), 12 * HOUR, SPAN_US, 240 * HOUR, 60, 4 * HOUR, HOUR // 60, n=2)


@query("joint_isi_histogram", f"WITH {ISI}, p AS (SELECT isi_us // {HOUR} AS a, lead(isi_us) OVER (PARTITION BY train_id ORDER BY i) // {HOUR} AS b FROM isi) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL AND a < 50 AND b < 50 GROUP BY ALL")
def _(spark, sf):
    return surrogates.joint_isi_histogram(event_trains(spark, sf), HOUR, 50)


# ---- spectra and causality ----


def _recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of neighbouring vector positions as recordings of two channels."""
    x = vector_signals(spark, sf, 64)
    return x.select(F.floor(F.col("channel") / 2).cast("int").alias("recording"), F.pmod("channel", F.lit(2)).alias("channel"), "k", "v")


_PI2 = "2 * pi()"


@query("periodogram", f"WITH {SAMPLES.format(n=64)}, m AS (SELECT channel, avg(v) AS a, count(*) AS n FROM samples GROUP BY 1), x AS (SELECT channel, n, o, (v - a) * (0.5 - 0.5 * cos({_PI2} * o / n)) AS v FROM (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY k) - 1 AS o FROM samples) JOIN m USING (channel)), f AS (SELECT channel, n, b, sum(v * cos({_PI2} * ((b * o) % n) / n)) AS re, sum(v * sin({_PI2} * ((b * o) % n) / n)) AS im FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS b FROM x) GROUP BY ALL), w AS (SELECT channel, sum(pow(0.5 - 0.5 * cos({_PI2} * o / n), 2)) AS s FROM x GROUP BY 1) SELECT channel::INT AS channel, b / n::DOUBLE AS freq, round(CASE WHEN b = 0 OR 2 * b = n THEN 1 ELSE 2 END * (re * re + im * im) / s, 6) AS psd FROM f JOIN w USING (channel)")
def _(spark, sf):
    from pulseloom.operators import spectral

    return spectral.welch_psd(vector_signals(spark, sf), n_segments=1).withColumn("psd", F.round("psd", 6))


@query("welch_psd")
def _(spark, sf):
    from pulseloom.operators import spectral

    return spectral.welch_psd(vector_signals(spark, sf, 64))


@query("multitaper_psd")
def _(spark, sf):
    from pulseloom.operators import spectral

    return spectral.multitaper_psd(vector_signals(spark, sf, 64), n_segments=4)


@query("multitaper_cross_spectrum")
def _(spark, sf):
    from pulseloom.operators import spectral

    return spectral.multitaper_cross_spectrum(_recordings(spark, sf), n_segments=4)


@query("coherence")
def _(spark, sf):
    from pulseloom.operators import spectral

    return spectral.coherence(_recordings(spark, sf))


@query("spike_field_coherence")
def _(spark, sf):
    from pulseloom.operators import spectral

    x = vector_signals(spark, sf, 64)
    events = table(spark, sf, "events").select(F.pmod("event_id", F.lit(64)).cast("int").alias("channel"), F.pmod(F.col("event_id") * 7, F.lit(200)).cast("long").alias("k"))
    return spectral.spike_field_coherence(x, events, length=64)


@query("weighted_phase_lag_index")
def _(spark, sf):
    from pulseloom.operators import spectral

    w = Window.partitionBy("trial_id", "channel").orderBy("k")
    x = vector_signals(spark, sf).withColumn("k", F.row_number().over(w))
    common = x.groupBy("trial_id").agg(F.max("k").alias("n")).agg(F.min("n").alias("common"))
    return spectral.weighted_phase_lag_index(x.crossJoin(F.broadcast(common)).where("k <= common").drop("common"))


@query("pairwise_granger")
def _(spark, sf):
    from pulseloom.operators import causality

    return causality.granger(_recordings(spark, sf), "recording", 3)


@query("conditional_granger")
def _(spark, sf):
    from pulseloom.operators import causality

    x = vector_signals(spark, sf).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x = x.select(F.pmod(F.col("channel") - F.col("part"), F.lit(64)).alias("recording"), F.col("part").alias("channel"), "k", "v")
    return causality.conditional_granger(x, "recording", 3)


@query("spectral_granger")
def _(spark, sf):
    from pulseloom.operators import causality

    return causality.spectral(_recordings(spark, sf), "recording", n_segments=8)


# ---- generators ----

for _kind, _options in (("poisson", {"refractory": 0.005}), ("gamma", {"shape": 2.0}), ("lognormal", {"sigma": 0.6}), ("inverse_gaussian", {"cv": 0.8})):

    @query(f"generate_{_kind}")
    def _(spark, sf, kind=_kind, options=_options):
        from pulseloom.operators import generators

        return generators.stationary(spark, kind, 20, 10.0, 0.0, 10.0, **options)


@query("generate_modulated")
def _(spark, sf):
    from pulseloom.operators import generators

    return generators.modulated(spark, "gamma", 20, [5.0] * 50 + [20.0] * 50, 0.1, shape=2.0)


@query("generate_compound_poisson")
def _(spark, sf):
    from pulseloom.operators import generators

    return generators.compound_poisson(spark, 5.0, [0.0, 0.8, 0.0, 0.0, 0.2], 50.0)


@query("generate_single_interaction")
def _(spark, sf):
    from pulseloom.operators import generators

    return generators.single_interaction(spark, 4, 10.0, 2.0, 20.0, 0.002)


@query("generate_granger_pair")
def _(spark, sf):
    from pulseloom.sources import datasets

    return datasets.load(spark, "granger_pair", length=2000)


# ---- patterns ----

_W = 3
_CTX = f"{UNITS}, cells AS (SELECT DISTINCT unit, trial_id * 24 + t_us // {HOUR} AS bin FROM units), st AS (SELECT DISTINCT bin AS win FROM cells), ctx AS (SELECT win, unit * {_W} + bin - win AS item FROM st JOIN cells ON bin BETWEEN win AND win + {_W - 1})"


def _mining_cells(spark: SparkSession, sf: str) -> DataFrame:
    return unit_trains(spark, sf).select("unit", (F.col("trial_id") * 24 + F.floor(F.col("t_us") / HOUR)).cast("long").alias("bin")).distinct()


@query("pattern_context", f"WITH {_CTX} SELECT win AS \"window\", item FROM ctx")
def _(spark, sf):
    from pulseloom.operators import patterns

    return patterns.context(_mining_cells(spark, sf), _W)


@query("pattern_pairs", f"WITH {SPIKES}, cells AS (SELECT DISTINCT train_id AS unit, t_us // {HOUR} AS bin FROM spikes), s AS (SELECT a.unit AS a, b.unit AS b, count(*) AS support FROM cells a JOIN cells b ON a.bin = b.bin AND a.unit < b.unit GROUP BY ALL), t AS (SELECT a.unit AS a, b.unit AS b, count(*) AS support FROM cells a JOIN cells b ON a.bin = b.bin AND a.unit < b.unit JOIN cells c ON c.bin = a.bin AND c.unit <> a.unit AND c.unit <> b.unit GROUP BY a.unit, b.unit, c.unit) SELECT a, b, support FROM s WHERE support >= 5 AND (a, b, support) NOT IN (SELECT (a, b, support) FROM t)")
def _(spark, sf):
    from pulseloom.operators import patterns

    cells = event_trains(spark, sf).select(F.col("train_id").alias("unit"), F.floor(F.col("t_us") / HOUR).cast("long").alias("bin"))
    out = patterns.closed_sets(patterns.context(cells, 1), 1, 2, 5, 2)
    return out.where(F.size("itemset") == 2).select(F.col("itemset")[0].alias("a"), F.col("itemset")[1].alias("b"), "support")


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    from pulseloom.operators import patterns

    cells = event_trains(spark, sf).select(F.col("train_id").alias("unit"), F.floor(F.col("t_us") / HOUR).cast("long").alias("bin"))
    return patterns.drop_window_subsets(patterns.closed_sets(patterns.context(cells, 2), 2, 2, 5), 2)


@query("closed_patterns")
def _(spark, sf):
    from pulseloom.operators import patterns

    return patterns.as_patterns(_mined(spark, sf), 2, HOUR)


@query("pattern_significance")
def _(spark, sf):
    from pulseloom.operators import patterns

    spikes = event_trains(spark, sf)
    moved = surrogates.dither_spikes(spikes, 3 * HOUR, 0, SPAN_US, 10, seed=1)
    cells = moved.select("surrogate", F.col("train_id").alias("unit"), F.floor(F.col("t_us") / HOUR).cast("long").alias("bin"))
    found = patterns.closed_sets(patterns.context(cells, 2, ["surrogate"]), 2, 2, 5, by=["surrogate"])
    return patterns.rejected(patterns.p_value_spectrum(found, 10), 0.2)


@query("pattern_stability")
def _(spark, sf):
    from pulseloom.operators import patterns

    cells = event_trains(spark, sf).select(F.col("train_id").alias("unit"), F.floor(F.col("t_us") / HOUR).cast("long").alias("bin"))
    return patterns.stability(_mined(spark, sf), patterns.context(cells, 2), 50).select("itemset", "support", "intensional", "extensional")


@query("spade_patterns")
def _(spark, sf):
    from pulseloom.operators import patterns

    cells = event_trains(spark, sf).select(F.col("train_id").alias("unit"), F.floor(F.col("t_us") / HOUR).cast("long").alias("bin"))
    return patterns.as_patterns(patterns.spade(cells, 2, n_subsets=50, stability_above=(0.9, 0.9), min_support=5), 2, HOUR)


@query("pair_coincidences", f"WITH {BINNED} SELECT a.train_id AS i, b.train_id AS j, b.bin - a.bin AS lag, sum(least(a.n, b.n))::BIGINT AS n FROM binned a JOIN binned b ON b.bin BETWEEN a.bin - 2 AND a.bin + 2 AND a.train_id < b.train_id GROUP BY ALL")
def _(spark, sf):
    from pulseloom.operators import patterns

    return patterns.pair_coincidences(hourly(spark, sf).counts, 2)


@query("cell_assemblies")
def _(spark, sf):
    from pulseloom.operators import patterns

    b = hourly(spark, sf)
    return patterns.assembly_pairs(b.counts, HOURS, 3, 0.9, 3)


# ---- sequences of synchronous events ----

_DAYS = f"{SPIKES}, cells AS (SELECT DISTINCT train_id, t_us // {6 * HOUR} AS bin FROM spikes)"


def _day_cells(spark: SparkSession, sf: str) -> DataFrame:
    return event_trains(spark, sf).select("train_id", F.floor(F.col("t_us") / (6 * HOUR)).cast("long").alias("bin")).distinct()


@query("transactions", f"WITH {_DAYS} SELECT bin, array_to_string(list_sort(list(train_id)), ',') AS ids FROM cells GROUP BY 1")
def _(spark, sf):
    from pulseloom.operators import sequences

    return sequences.transactions(_day_cells(spark, sf)).select("bin", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


for _norm, _by in ((None, "n"), ("intersection", "round(n / least(a.s, b.s), 9)"), ("mean", "round(n / sqrt(a.s * b.s), 9)"), ("union", "round(n / (a.s + b.s - n), 9)")):

    @query(f"intersection_matrix_{_norm or 'counts'}", f"WITH {_DAYS}, s AS (SELECT bin, count(*) AS s FROM cells GROUP BY 1), m AS (SELECT a.bin AS i, b.bin AS j, count(*) AS n FROM cells a JOIN cells b USING (train_id) GROUP BY ALL) SELECT i, j, {_by} AS value FROM m JOIN s a ON i = a.bin JOIN s b ON j = b.bin")
    def _(spark, sf, norm=_norm):
        from pulseloom.operators import sequences

        out = sequences.intersection_matrix(_day_cells(spark, sf), None, norm)
        return out if norm is None else out.withColumn("value", F.round("value", 9))


def _pmat(spark: SparkSession, sf: str) -> DataFrame:
    from pulseloom.operators import sequences

    cells = _day_cells(spark, sf)
    p = sequences.boxcar_rates(cells, cells.select("train_id").distinct(), 120, 9)
    return sequences.probability_matrix(sequences.intersection_matrix(cells), p)


@query("boxcar_rates", f"WITH {_DAYS}, g AS (SELECT t.train_id, r.bin, CASE WHEN c.bin IS NULL THEN 0 ELSE 1 END AS x FROM (SELECT DISTINCT train_id FROM cells) t CROSS JOIN range(0, 120) AS r(bin) LEFT JOIN cells c ON c.train_id = t.train_id AND c.bin = r.bin), r AS (SELECT train_id, bin, sum(x) OVER (PARTITION BY train_id ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0::DOUBLE AS p FROM g) SELECT train_id, bin, round(CASE WHEN bin < 4 THEN max(CASE WHEN bin = 4 THEN p END) OVER (PARTITION BY train_id) WHEN bin > 115 THEN max(CASE WHEN bin = 115 THEN p END) OVER (PARTITION BY train_id) ELSE p END, 9) AS p FROM r")
def _(spark, sf):
    from pulseloom.operators import sequences

    cells = _day_cells(spark, sf)
    return sequences.boxcar_rates(cells, cells.select("train_id").distinct(), 120, 9).withColumn("p", F.round("p", 9))


@query("probability_matrix")
def _(spark, sf):
    return _pmat(spark, sf)


@query("probability_matrix_surrogates")
def _(spark, sf):
    from pulseloom.operators import sequences

    moved = surrogates.dither_spikes(event_trains(spark, sf), 30 * HOUR, 0, SPAN_US, 20, seed=4)
    drawn = moved.select("surrogate", "train_id", F.floor(F.col("t_us") / (6 * HOUR)).cast("long").alias("bin"))
    return sequences.probability_matrix_by_surrogates(sequences.intersection_matrix(_day_cells(spark, sf)), drawn, 20)


@query("joint_probability_matrix")
def _(spark, sf):
    from pulseloom.operators import sequences

    return sequences.joint_probability_matrix(_pmat(spark, sf), 5, 1, 3)


@query("synchronous_event_clusters")
def _(spark, sf):
    from pulseloom.operators import sequences

    cells = _day_cells(spark, sf)
    pixels = sequences.mask([sequences.intersection_matrix(cells), _pmat(spark, sf)], [1, 0.9]).where("i <> j")
    labels = sequences.cluster(pixels, 3.0, 2, 5.0)
    return sequences.synchronous_events(labels, cells).select("label", "i", "j", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# ---- populations, change points, densities, latents ----


@query("cumulants", f"WITH {BINNED}, h AS (SELECT r.bin, coalesce(sum(n), 0)::DOUBLE AS v FROM range(0, {HOURS}) AS r(bin) LEFT JOIN binned USING (bin) GROUP BY 1), s AS (SELECT count(*) AS n, sum(v) AS a, sum(v * v) AS b, sum(v * v * v) AS c FROM h) SELECT round(a / n, 6) AS k1, round((b - a * a / n) / (n - 1), 6) AS k2, round(n * (c - 3 * (a / n) * b + 2 * n * pow(a / n, 3)) / ((n - 1) * (n - 2)), 4) AS k3 FROM s")
def _(spark, sf):
    from pulseloom.operators import population

    _, k1, k2, k3 = population.kstat(rates.time_histogram(hourly(spark, sf)))
    return spark.range(1).select(F.round(F.lit(k1), 6).alias("k1"), F.round(F.lit(k2), 6).alias("k2"), F.round(F.lit(k3), 4).alias("k3"))


@query("cubic")
def _(spark, sf):
    from pulseloom.operators import population

    try:
        order, p, _ = population.cubic(rates.time_histogram(hourly(spark, sf)))
    except population.Untestable:  # a row that has no order
        order, p = None, [None]
    return spark.createDataFrame([(order, p[-1])], "xi int, p_value double")


@query("multiple_filter_test")
def _(spark, sf):
    from pulseloom.operators import population

    t = event_trains(spark, sf).select("train_id", (F.col("t_us") / 1e6 / 3600).alias("t"))
    return population.multiple_filter_test(t, [48.0, 96.0], 720.0, step=6.0)


@query("standard_csd", f"WITH {SAMPLES.format(n=64)} SELECT channel::INT AS channel, k, round(-0.3 * (coalesce(lag(v) OVER w, v) - 2 * v + coalesce(lead(v) OVER w, v)) / 0.1, 6) AS csd FROM samples WINDOW w AS (PARTITION BY k ORDER BY channel)")
def _(spark, sf):
    from pulseloom.operators import density

    return density.standard_csd(vector_signals(spark, sf, 64), 0.1).withColumn("csd", F.round("csd", 6))


for _method in ("delta", "step", "spline", "kernel"):

    @query(f"{_method}_csd")
    def _(spark, sf, method=_method):
        import numpy as np

        from pulseloom.operators import density

        z = np.arange(1, 65) * 0.1
        m = {
            "delta": lambda: density.delta_matrix(z, 0.5), "step": lambda: density.step_matrix(z, 0.5), "spline": lambda: density.spline_matrix(z, 0.5, np.linspace(0.1, 6.4, 127)),
            "kernel": lambda: density.kernel_matrix(z[:, None], np.linspace(0.1, 6.4, 127)[:, None], 0.15, 1e-3),
        }[method]()
        return density.apply_matrix(vector_signals(spark, sf, 64), m)


@query("latent_trajectories")
def _(spark, sf):
    from pulseloom.operators import latent

    c = unit_trains(spark, sf).groupBy("trial_id", "unit", F.floor(F.col("t_us") / HOUR).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    model = latent.fit(c, [1, 2, 3, 4, 5], 24, 2, 5)
    return latent.transform(c, model, [1, 2, 3, 4, 5], 24)


@query("stream_histogram", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    from pulseloom.streaming.counts import histogram

    return histogram(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
