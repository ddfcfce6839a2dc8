"""Fault frequency, bins, latches and precursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import character as ops
from fleetlens.operators import onsets as onset_ops
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, half_even, with_views

BIN_S = 7200
HORIZONS = (21600, 43200, 86400)
BASELINE_S = 432000
EXCLUDE_S = 86400


@query(
    "frequency",
    with_views(
        f"""WITH s AS (SELECT count(DISTINCT gpu) * ((max(us) - min(us)) / 1000000.0::DOUBLE) / 3600.0::DOUBLE AS h FROM gauge),
        t AS (SELECT count(*) AS n, count(DISTINCT gpu) AS g FROM ons)
        SELECT n AS total_events, g AS distinct_event_gpus, {half_even('h', 1)} AS observed_gpu_hours, {half_even('h / n', 1)} AS mtbf_gpu_hours_per_event,
        {half_even('n / h', 6)} AS events_per_gpu_hour FROM s, t""",
        "ons",
    ),
)
def frequency(spark, sf_dir):
    """Mean device-hours between faults over the observed fleet and span."""
    gauge = views.gauge(spark, sf_dir)
    fleet = gauge.agg(F.count_distinct("gpu"))
    span = onset_ops.sample_span(gauge).select("span_seconds")
    return ops.frequency(views.onsets(spark, sf_dir), fleet, span)


@query(
    "onsets_by_day",
    with_views("SELECT strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(*) AS events FROM ons GROUP BY 1", "ons"),
)
def onsets_by_day(spark, sf_dir):
    return ops.by_day(views.onsets(spark, sf_dir))


_BINS = f"b AS (SELECT *, (us - (SELECT min(us) FROM ons)) // {BIN_S * 1000000} AS bin FROM ons), top AS (SELECT bin FROM b GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1)"


@query(
    "largest_bin",
    with_views(
        f"""WITH {_BINS} SELECT CAST(min(bin) AS BIGINT) AS bin, strftime(min(ts), {ISO}) AS window_start, strftime(max(ts), {ISO}) AS window_end, count(*) AS events,
        count(DISTINCT gpu) AS distinct_gpus, count(DISTINCT node) AS distinct_nodes, {half_even('count(*) / (SELECT count(*) FROM ons)::DOUBLE', 3)} AS frac_of_all_events,
        (SELECT count(*) FROM ons) - count(*) AS sporadic_events FROM b WHERE bin = (SELECT bin FROM top)""",
        "ons",
    ),
)
def largest_bin(spark, sf_dir):
    row = ops.largest_bin(views.onsets(spark, sf_dir), BIN_S)
    return row.withColumn("window_start", iso("window_start")).withColumn("window_end", iso("window_end"))


@query(
    "largest_bin_codes",
    with_views(f"WITH {_BINS} SELECT CAST(code AS INTEGER) AS code, count(*) AS events FROM b WHERE bin = (SELECT bin FROM top) GROUP BY code", "ons"),
)
def largest_bin_codes(spark, sf_dir):
    return ops.largest_bin_codes(views.onsets(spark, sf_dir), BIN_S)


@query("sample_counts", with_views(f"SELECT strftime(ts, {ISO}) AS ts, count(*) AS n_onsets FROM gons GROUP BY ts", "gons"))
def sample_counts(spark, sf_dir):
    return ops.sample_counts(views.grid_onsets(spark, sf_dir)).withColumn("ts", iso("ts"))


@query(
    "timeline",
    with_views(
        f"""SELECT strftime(g.ts, {ISO}) AS ts, count(o.us) AS n_onsets FROM (SELECT unnest(range(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 00:00:01', INTERVAL 1 HOUR)) AS ts) g
        LEFT JOIN gons o ON o.ts = g.ts GROUP BY g.ts""",
        "gons",
    ),
)
def timeline(spark, sf_dir):
    rows = ops.timeline(views.grid_onsets(spark, sf_dir), "2024-01-01 00:00:00", "2024-01-31 00:00:00", views.GRID_S)
    return rows.withColumn("ts", iso("ts"))


@query(
    "onset_scope",
    with_views("SELECT count(*) AS n_onsets, count(DISTINCT gpu) AS n_gpus, count(DISTINCT node) AS n_nodes, count(DISTINCT code) AS n_codes FROM ons", "ons"),
)
def onset_scope(spark, sf_dir):
    return ops.scope(views.onsets(spark, sf_dir))


@query(
    "gpus_per_node",
    with_views("SELECT gpus_on_node, count(*) AS n_nodes FROM (SELECT node, count(DISTINCT gpu) AS gpus_on_node FROM ons GROUP BY node) GROUP BY 1", "ons"),
)
def gpus_per_node(spark, sf_dir):
    return ops.gpus_per_node(views.onsets(spark, sf_dir))


_LATCH = """WITH busy AS (SELECT us FROM gons GROUP BY us ORDER BY count(*) DESC, us LIMIT 1),
 st AS (SELECT us AS t0 FROM busy), aff AS (SELECT DISTINCT gpu FROM ons),
 l AS (SELECT g.* FROM gauge g, st WHERE g.us >= st.t0 AND g.gpu IN (SELECT gpu FROM aff)),
 f AS (SELECT gpu, min(us) AS f FROM l WHERE code <> 0 GROUP BY gpu),
 e AS (SELECT f.gpu, f.f, min(l.us) FILTER (WHERE l.us > f.f AND (l.code IS NULL OR l.code = 0)) AS e FROM f JOIN l ON l.gpu = f.gpu GROUP BY 1, 2),
 r AS (SELECT e.gpu, count(*) FILTER (WHERE l.us >= e.f AND (e.e IS NULL OR l.us < e.e)) AS latched_samples,
   CASE WHEN min(e.e) IS NULL THEN 'faulted-to-window-end' WHEN count(l.code) FILTER (WHERE l.us = e.e) = 0 THEN 'went-idle' ELSE 'cleared-to-0' END AS terminal
   FROM e JOIN l ON l.gpu = e.gpu GROUP BY e.gpu, e.f, e.e)"""


def _latches(spark, sf_dir):
    rows = views.onsets(spark, sf_dir)
    busiest = ops.sample_counts(views.grid_onsets(spark, sf_dir)).orderBy(F.desc("n_onsets"), "ts").limit(1).select("ts")
    return ops.latch_lengths(views.gauge(spark, sf_dir), rows, busiest, chunk_seconds=86400)


@query("latch_lengths", with_views(_LATCH + " SELECT gpu, latched_samples, terminal FROM r", "gauge", "gons"))
def latch_lengths(spark, sf_dir):
    """How long each faulting device stays latched after the busiest sample, and how that ends."""
    return _latches(spark, sf_dir)


@query(
    "latch_summary",
    with_views(
        _LATCH
        + """, s AS (SELECT *, row_number() OVER (ORDER BY latched_samples) - 1 AS i, count(*) OVER () AS n FROM r)
        SELECT count(*) AS n_gpus, min(latched_samples) AS min_run, max(latched_samples) FILTER (WHERE i = n // 2) AS upper_median_run, max(latched_samples) AS max_run,
        count(*) FILTER (WHERE terminal = 'went-idle') AS went_idle, count(*) FILTER (WHERE terminal = 'cleared-to-0') AS cleared,
        count(*) FILTER (WHERE terminal = 'faulted-to-window-end') AS to_window_end FROM s""",
        "gauge",
        "gons",
    ),
)
def latch_summary(spark, sf_dir):
    return ops.latch_summary(_latches(spark, sf_dir))


_PRE = """WITH d AS (SELECT gpu, metric, count(*) AS n_samples, arg_max(value, us) - arg_min(value, us) AS delta FROM tel
 WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00' AND gpu IN (SELECT gpu FROM ons) GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _deltas(spark, sf_dir):
    lo, hi = F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-17 00:00:00").cast("timestamp")
    return ops.pre_window_deltas(views.telemetry(spark, sf_dir), views.onsets(spark, sf_dir), lo, hi)


@query("pre_window_deltas", with_views(_PRE + " SELECT gpu, metric, n_samples, round(delta, 6) AS delta FROM d", "tel", "ons"))
def pre_window_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir).withColumn("delta", F.round("delta", 6))


@query(
    "delta_summary",
    with_views(
        _PRE
        + """, s AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM d)
        SELECT metric, count(*) AS n_gpus, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta, count(*) FILTER (WHERE delta > 0) AS rising,
        round(max(delta) FILTER (WHERE i = n // 2), 6) AS upper_median_delta FROM s GROUP BY metric""",
        "tel",
        "ons",
    ),
)
def delta_summary(spark, sf_dir):
    out = ops.delta_summary(_deltas(spark, sf_dir))
    for c in ("min_delta", "max_delta", "upper_median_delta"):
        out = out.withColumn(c, F.round(c, 6))
    return out


_LEADS = " UNION ALL ".join(
    f"""SELECT {h} AS horizon_s, gpu, t0, metric, avg(value) FILTER (WHERE us >= t0 - {h * 1000000}) AS lead,
    CASE WHEN count(*) FILTER (WHERE us >= t0 - {h * 1000000}) > 1 THEN regr_slope(value, (us - t0) / 60000000.0) FILTER (WHERE us >= t0 - {h * 1000000}) END AS slope,
    median(value) FILTER (WHERE us < t0 - {EXCLUDE_S * 1000000}) AS base_med,
    coalesce(stddev_samp(value) FILTER (WHERE us < t0 - {EXCLUDE_S * 1000000}), 0.0) AS base_std FROM w GROUP BY gpu, t0, metric"""
    for h in HORIZONS
)


@query(
    "precursors",
    with_views(
        f"""WITH w AS (SELECT o.gpu, o.us AS t0, t.metric, t.us, t.value FROM (SELECT DISTINCT gpu, us FROM ons) o JOIN tel t ON t.gpu = o.gpu AND t.us >= o.us - {BASELINE_S * 1000000} AND t.us < o.us),
        l AS ({_LEADS}), d AS (SELECT *, lead - base_med AS delta FROM l WHERE lead IS NOT NULL AND base_med IS NOT NULL)
        SELECT metric, CAST(horizon_s AS INTEGER) AS horizon_s, count(*) AS events_with_lead_samples, round(avg(delta), 4) AS mean_delta, round(avg(slope), 4) AS mean_slope_per_min,
        round(avg(CASE WHEN (base_std > 0 AND abs(delta) >= 2 * base_std) OR (base_std = 0 AND abs(delta) > 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS frac_detectable_2sigma,
        round(median(delta), 4) AS median_delta FROM d GROUP BY metric, horizon_s""",
        "ons",
        "tel",
    ),
)
def precursors(spark, sf_dir):
    """Sensor shift before faults against each device's own earlier baseline."""
    rows = ops.precursors(
        views.telemetry(spark, sf_dir), views.onsets(spark, sf_dir), horizons_s=HORIZONS, baseline_s=BASELINE_S, exclude_s=EXCLUDE_S
    )
    for c, d in (("mean_delta", 4), ("mean_slope_per_min", 4), ("median_delta", 4), ("frac_detectable_2sigma", 6)):
        rows = rows.withColumn(c, F.round(c, d))
    return rows
