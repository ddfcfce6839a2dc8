"""Alerting and missed onsets over the labelled points with a plain score."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import incidents as incident_ops
from fleetlens.operators import monitor as ops
from fleetlens.operators import onsets as onset_ops
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, with_views

H_US = [int(h * 1e6) for h in views.HORIZONS_S]
MISS_H = 43200.0

_THR = """so AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM scored),
 bq AS (SELECT unnest([0.01, 0.05, 0.10]::DOUBLE[]) AS budget),
 bp AS (SELECT budget, ((SELECT count(*) FROM scored) - 1) * (1.0::DOUBLE - budget) AS vp FROM bq),
 thr AS (SELECT budget, lo.score + (hi.score - lo.score) * (vp - floor(vp)) AS threshold FROM bp JOIN so lo ON lo.i = CAST(floor(vp) AS BIGINT) JOIN so hi ON hi.i = CAST(ceil(vp) AS BIGINT)),
 flg AS (SELECT s.gpu, s.ref, s.horizon_s AS row_horizon_s, s.score, s.GPU_UTIL_max, t.budget, s.score >= t.threshold AS alert_flag FROM scored s, thr t),
 evt AS (SELECT DISTINCT gpu, ref + CAST(horizon_s * 1000000 AS BIGINT) AS t FROM scored WHERE label = 1)"""
_GRID = """grd AS (SELECT e.gpu, e.t, b.budget, h.horizon_s, coalesce(bool_or(f.alert_flag), FALSE) AS caught FROM evt e CROSS JOIN bq b CROSS JOIN hz h
 LEFT JOIN flg f ON f.gpu = e.gpu AND f.budget = b.budget AND f.ref >= e.t - CAST(h.horizon_s * 1000000 AS BIGINT) AND f.ref < e.t GROUP BY 1, 2, 3, 4)"""


def _flagged(spark, sf_dir):
    rows = views.scored(spark, sf_dir).select("gpu", "t_ref", "horizon_s", "label", "score", "GPU_UTIL_max")
    return rows, ops.score_flags(rows, ops.thresholds(rows))


@query("alert_thresholds", with_views(f"WITH {_THR} SELECT budget, round(threshold, 9) AS threshold FROM thr", "scored"))
def alert_thresholds(spark, sf_dir):
    """Score threshold per alert budget."""
    return ops.thresholds(views.scored(spark, sf_dir)).withColumn("threshold", F.round("threshold", 9))


@query(
    "alert_rates",
    with_views(
        f"WITH {_THR} SELECT budget, count(*) AS n_rows, count(*) FILTER (WHERE alert_flag) AS n_alerts, round(avg(CASE WHEN alert_flag THEN 1.0 ELSE 0.0 END), 9) AS alert_rate FROM flg GROUP BY budget",
        "scored",
    ),
)
def alert_rates(spark, sf_dir):
    _, flagged = _flagged(spark, sf_dir)
    return ops.alert_rates(flagged).withColumn("alert_rate", F.round("alert_rate", 9))


@query(
    "horizon_grid",
    with_views(
        f"""WITH {_THR}, {_GRID} SELECT budget, horizon_s, count(*) AS n_onsets, count(*) FILTER (WHERE caught) AS caught, count(*) FILTER (WHERE NOT caught) AS missed,
        round(avg(CASE WHEN caught THEN 1.0 ELSE 0.0 END), 9) AS recall FROM grd GROUP BY 1, 2""",
        "scored",
    ),
)
def horizon_grid(spark, sf_dir):
    """Recall per budget and warning horizon."""
    rows, flagged = _flagged(spark, sf_dir)
    grid = ops.horizon_grid(flagged, onset_ops.onsets_from_points(rows), views.HORIZONS_S)
    return grid.withColumn("recall", F.round("recall", 9))


@query(
    "monitor_report",
    with_views(
        f"""WITH {_THR}, {_GRID}, ar AS (SELECT budget, avg(CASE WHEN alert_flag THEN 1.0 ELSE 0.0 END) AS alert_rate FROM flg GROUP BY budget)
        SELECT g.budget, horizon_s, round(any_value(t.threshold), 9) AS threshold, round(any_value(ar.alert_rate), 9) AS alert_rate, count(*) AS n_onsets, count(*) FILTER (WHERE caught) AS caught,
        count(*) FILTER (WHERE NOT caught) AS missed, round(avg(CASE WHEN caught THEN 1.0 ELSE 0.0 END), 9) AS recall
        FROM grd g JOIN thr t ON t.budget = g.budget JOIN ar ON ar.budget = g.budget GROUP BY 1, 2""",
        "scored",
    ),
)
def monitor_report(spark, sf_dir):
    """The whole alert report in one table."""
    rows = ops.monitor_report(views.scored(spark, sf_dir), horizons_s=views.HORIZONS_S)
    for c in ("threshold", "alert_rate", "recall"):
        rows = rows.withColumn(c, F.round(c, 9))
    return rows


_MISS = f"""ev2 AS (SELECT e.gpu, e.t, b.budget FROM evt e CROSS JOIN bq b),
 prr AS (SELECT e.gpu, e.t, e.budget, f.ref, f.row_horizon_s, f.score, f.alert_flag, f.GPU_UTIL_max FROM ev2 e JOIN flg f ON f.gpu = e.gpu AND f.budget = e.budget
   AND f.ref >= e.t - {int(MISS_H * 1e6)} AND f.ref < e.t),
 lst AS (SELECT *, row_number() OVER (PARTITION BY gpu, t, budget ORDER BY ref DESC, row_horizon_s DESC) AS rn FROM prr),
 cnt AS (SELECT gpu, t, budget, count(*) AS n_rows, count(*) FILTER (WHERE alert_flag) AS n_alerts FROM prr GROUP BY 1, 2, 3),
 mis AS (SELECT e.gpu, e.t, e.budget, coalesce(c.n_alerts, 0) > 0 AS caught, coalesce(c.n_alerts, 0) AS n_alerts_in_window, coalesce(c.n_rows, 0) AS n_rows_in_window,
   l.score AS last_score, l.GPU_UTIL_max AS last_util_max FROM ev2 e LEFT JOIN cnt c ON c.gpu = e.gpu AND c.t = e.t AND c.budget = e.budget
   LEFT JOIN lst l ON l.gpu = e.gpu AND l.t = e.t AND l.budget = e.budget AND l.rn = 1)"""


def _misses(spark, sf_dir):
    rows, flagged = _flagged(spark, sf_dir)
    return ops.detect_misses(flagged, onset_ops.onsets_from_points(rows), horizon_s=MISS_H, model_version=1, features=["GPU_UTIL_max"])


@query(
    "miss_events",
    with_views(f"WITH {_THR}, {_MISS} SELECT gpu, strftime(make_timestamp(t), {ISO}) AS onset_ts, budget, caught, n_alerts_in_window, n_rows_in_window, last_score, last_util_max FROM mis", "scored"),
)
def miss_events(spark, sf_dir):
    """Every onset with its alerts in the twelve hours before and the last features seen."""
    return _misses(spark, sf_dir).select(
        "gpu", iso("onset_ts").alias("onset_ts"), "budget", "caught", "n_alerts_in_window", "n_rows_in_window", "last_score",
        F.col("pre_event_features")["GPU_UTIL_max"].alias("last_util_max"),
    )


@query(
    "prior_scores",
    with_views(
        f"WITH {_THR}, {_MISS} SELECT gpu, strftime(make_timestamp(t), {ISO}) AS onset_ts, budget, strftime(make_timestamp(ref), {ISO}) AS t_ref, row_horizon_s, score, alert_flag FROM prr", "scored"
    ),
)
def prior_scores(spark, sf_dir):
    """The scored rows each onset had before it."""
    rows, flagged = _flagged(spark, sf_dir)
    near = ops.prior_scores(flagged, onset_ops.onsets_from_points(rows), MISS_H)
    return near.select("gpu", iso("ts").alias("onset_ts"), "budget", iso("t_ref").alias("t_ref"), "row_horizon_s", "score", "alert_flag")


@query(
    "miss_incidents",
    with_views(
        f"""WITH {_THR}, {_MISS} SELECT gpu || '@' || strftime(make_timestamp(t), {ISO}) AS incident_id, 'missed_onset' AS source, budget, CAST(NULL AS DOUBLE) AS xid, NOT caught AS missed,
        n_alerts_in_window FROM mis WHERE NOT caught""",
        "scored",
    ),
)
def miss_incidents(spark, sf_dir):
    """Missed onsets in the common incident shape."""
    rows = incident_ops.from_misses(_misses(spark, sf_dir).where(~F.col("caught")))
    return rows.select(
        "incident_id", "source", F.col("detection.budget").alias("budget"), F.col("observed.xid").alias("xid"),
        F.col("detection.missed").alias("missed"), F.col("detection.n_alerts_in_window").alias("n_alerts_in_window"),
    )


@query(
    "report_rows",
    with_views(
        f"WITH {_THR} SELECT gpu, strftime(make_timestamp(ref), {ISO}) AS t_ref, row_horizon_s AS horizon_s, score, alert_flag FROM flg WHERE budget = 0.01 ORDER BY ref, gpu, row_horizon_s LIMIT 500", "scored"
    ),
)
def report_rows(spark, sf_dir):
    """The first 500 scored rows of the report (the report's own limit)."""
    _, flagged = _flagged(spark, sf_dir)
    return ops.report_rows(flagged, 0.01).select("gpu", iso("t_ref").alias("t_ref"), "horizon_s", "score", "alert_flag")
