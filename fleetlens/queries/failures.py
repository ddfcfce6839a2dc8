"""Failures, their neighbours in time, and the stress before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import onsets as onset_ops
from fleetlens.operators import rca
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, half_even, with_views

DAYS2 = 172800
CENTER_DAY = "1998-02-06 00:00:00"
WINDOW_MIN = 30


@query(
    "failed_jobs",
    with_views(f"SELECT job_id, type, state, strftime(fail_ts, {ISO}) AS fail_ts FROM jobs WHERE state IN ('FAILED', 'NODE_FAIL')", "jobs"),
)
def failed_jobs(spark, sf_dir):
    rows = rca.failed_jobs(views.order_jobs(spark, sf_dir))
    return rows.select("job_id", "type", "state", iso("fail_ts").alias("fail_ts"))


@query(
    "incidents",
    with_views(
        f"SELECT job_id, type, state, strftime(fail_ts, {ISO}) AS fail_ts, CAST(NULL AS DOUBLE) AS fail_rel FROM jobs WHERE state IN ('FAILED', 'NODE_FAIL')", "jobs"
    ),
)
def incidents(spark, sf_dir):
    rows = rca.incidents(views.order_jobs(spark, sf_dir))
    return rows.select("job_id", "type", "state", iso("fail_ts").alias("fail_ts"), "fail_rel")


@query(
    "jobs_near",
    with_views(
        f"""SELECT job_id, type, strftime(fail_ts, {ISO}) AS fail_ts FROM jobs WHERE state IN ('FAILED', 'NODE_FAIL')
        AND fail_ts <> TIMESTAMP '{CENTER_DAY}' AND abs(us - epoch_us(TIMESTAMP '{CENTER_DAY}')) <= {DAYS2 * 1000000}""",
        "jobs",
    ),
)
def jobs_near(spark, sf_dir):
    near = rca.jobs_near(rca.incidents(views.order_jobs(spark, sf_dir)), CENTER_DAY, DAYS2)
    return near.select("job_id", "type", iso("fail_ts").alias("fail_ts"))


@query(
    "correlated_failures",
    with_views(
        f"""WITH f AS (SELECT * FROM jobs WHERE state IN ('FAILED', 'NODE_FAIL')), d AS (SELECT DISTINCT us FROM f)
        SELECT strftime(make_timestamp(d.us), {ISO}) AS fail_ts, count(f.job_id) AS n_correlated,
        CASE WHEN count(DISTINCT f.type) = 1 THEN min(f.type) END AS shared_type
        FROM d LEFT JOIN f ON f.us <> d.us AND abs(f.us - d.us) <= {DAYS2 * 1000000} GROUP BY d.us""",
        "jobs",
    ),
)
def correlated_failures(spark, sf_dir):
    """Other failures within two days of every failure time, and their common type."""
    rows = rca.correlated_failures(rca.incidents(views.order_jobs(spark, sf_dir)), DAYS2)
    return rows.select(iso("fail_ts").alias("fail_ts"), "n_correlated", "shared_type")


@query(
    "onset_cohort",
    with_views(
        """SELECT count(*) AS count, count(DISTINCT gpu) AS n_gpus, CAST(CASE WHEN min(code) = max(code) THEN min(code) END AS INTEGER) AS observed_code
        FROM ons WHERE abs(us - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) <= 10800000000""",
        "ons",
    ),
)
def onset_cohort(spark, sf_dir):
    return rca.onset_cohort_summary(views.onsets(spark, sf_dir), "2024-01-10 12:00:00", 10800)


@query(
    "onset_cohorts",
    with_views(
        f"""SELECT strftime(make_timestamp(j.us), {ISO}) AS fail_ts, count(o.us) AS n_onsets,
        CAST(CASE WHEN min(o.code) = max(o.code) THEN min(o.code) END AS BIGINT) AS observed_code
        FROM (SELECT DISTINCT us FROM fjobs) j LEFT JOIN ons o ON abs(o.us - j.us) <= {WINDOW_MIN * 60 * 1000000} GROUP BY j.us""",
        "fjobs",
        "ons",
    ),
)
def onset_cohorts(spark, sf_dir):
    """Onsets around every failed job's time, with the code when they agree."""
    rows = rca.onset_cohorts(views.fleet_jobs(spark, sf_dir), views.onsets(spark, sf_dir), WINDOW_MIN * 60)
    return rows.select(iso("fail_ts").alias("fail_ts"), "n_onsets", "observed_code")


_COINC = f"""WITH sp AS (SELECT min(us) AS lo, max(us) AS hi FROM gauge WHERE code IS NOT NULL),
 u AS (SELECT DISTINCT us FROM ons),
 j AS (SELECT f.* FROM fjobs f, sp WHERE f.us BETWEEN sp.lo AND sp.hi),
 n AS (SELECT j.job_id, count(o.us) AS n_onsets FROM j LEFT JOIN ons o ON abs(o.us - j.us) <= {WINDOW_MIN * 60 * 1000000} GROUP BY 1),
 b AS (SELECT j.job_id, j.us, u.us AS t FROM j ASOF LEFT JOIN u ON j.us >= u.us),
 a AS (SELECT j.job_id, u.us AS t FROM j ASOF LEFT JOIN u ON j.us <= u.us),
 res AS (SELECT b.job_id, n.n_onsets, CASE WHEN a.t IS NULL OR b.us - b.t <= a.t - b.us THEN b.t ELSE a.t END AS nearest
   FROM b JOIN a USING (job_id) JOIN n USING (job_id))"""


def _coincidence(spark, sf_dir):
    span = onset_ops.populated_span(views.gauge(spark, sf_dir))
    return rca.coincidence(views.fleet_jobs(spark, sf_dir), views.onsets(spark, sf_dir), WINDOW_MIN, span)


@query(
    "coincidence",
    with_views(
        _COINC + f" SELECT job_id, n_onsets > 0 AS matched, n_onsets, strftime(make_timestamp(nearest), {ISO}) AS nearest_onset FROM res",
        "fjobs",
        "ons",
    ),
)
def coincidence(spark, sf_dir):
    """Each failed job with its onset count within half an hour and the nearest onset."""
    return _coincidence(spark, sf_dir).select("job_id", "matched", "n_onsets", iso("nearest_onset").alias("nearest_onset"))


@query(
    "coincidence_rate",
    with_views(
        _COINC + " SELECT count(*) AS n_jobs, count(*) FILTER (WHERE n_onsets > 0) AS n_matched, round(coalesce(avg(CASE WHEN n_onsets > 0 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS rate FROM res",
        "fjobs",
        "ons",
    ),
)
def coincidence_rate(spark, sf_dir):
    return rca.coincidence_rate(_coincidence(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(
    "jobs_near_centers",
    with_views(
        f"""WITH c AS (SELECT us FROM gons GROUP BY us HAVING count(*) >= 5)
        SELECT job_id, strftime(ts, {ISO}) AS fail_ts FROM fjobs WHERE EXISTS (SELECT 1 FROM c WHERE abs(c.us - fjobs.us) <= {WINDOW_MIN * 60 * 1000000})""",
        "fjobs",
        "gons",
    ),
)
def jobs_near_centers(spark, sf_dir):
    """Failed jobs within half an hour of any dense sample."""
    dense = views.grid_onsets(spark, sf_dir).groupBy("ts").agg(F.count("*").alias("n")).where("n >= 5")
    rows = rca.jobs_near_centers(views.fleet_jobs(spark, sf_dir), dense, WINDOW_MIN)
    return rows.select("job_id", iso("fail_ts").alias("fail_ts"))


@query(
    "incident_telemetry",
    with_views(
        f"""WITH c AS (SELECT DISTINCT us FROM fjobs), m AS (SELECT unnest(['GPU_TEMP', 'POWER_USAGE']) AS metric)
        SELECT strftime(make_timestamp(c.us), {ISO}) AS fail_ts, CASE m.metric WHEN 'POWER_USAGE' THEN 'DCGM_FI_DEV_POWER_USAGE' ELSE 'DCGM_FI_DEV_GPU_TEMP' END AS field,
        count(t.value) > 0 AS available, count(DISTINCT t.us) AS samples, coalesce(round(avg(t.value), 9), 0.0) AS mean,
        coalesce(max(t.value), 0.0) AS max, coalesce(min(t.value), 0.0) AS min
        FROM c CROSS JOIN m LEFT JOIN tel t ON t.metric = m.metric AND t.us BETWEEN c.us - 3600000000 AND c.us + 3600000000 GROUP BY c.us, m.metric""",
        "fjobs",
        "tel",
    ),
)
def incident_telemetry(spark, sf_dir):
    """Power and temperature in the hour either side of every failed job."""
    rows = rca.incident_telemetry(views.telemetry(spark, sf_dir), views.fleet_jobs(spark, sf_dir), 3600)
    return rows.select(iso("fail_ts").alias("fail_ts"), "field", "available", "samples", F.round("mean", 9).alias("mean"), "max", "min")


@query(
    "degradation",
    with_views(
        f"""WITH c AS (SELECT DISTINCT us FROM fjobs), s AS (SELECT c.us,
        max(t.value) FILTER (WHERE metric = 'POWER_USAGE') AS pmax, sum(t.value) FILTER (WHERE metric = 'POWER_USAGE') / count(t.value) FILTER (WHERE metric = 'POWER_USAGE') AS pmean,
        max(t.value) FILTER (WHERE metric = 'GPU_TEMP') AS tmax, min(t.value) FILTER (WHERE metric = 'GPU_TEMP') AS tmin
        FROM c LEFT JOIN tel t ON t.us BETWEEN c.us - 14400000000 AND c.us GROUP BY c.us),
        r AS (SELECT us, CASE WHEN pmean > 0 THEN {half_even('pmax / pmean', 2)} ELSE 0.0 END AS power_spike_ratio,
        CASE WHEN tmax IS NOT NULL THEN {half_even('tmax - tmin', 1)} ELSE 0.0 END AS temp_rise_C FROM s)
        SELECT strftime(make_timestamp(us), {ISO}) AS fail_ts, power_spike_ratio, temp_rise_C, power_spike_ratio > 1.5 OR temp_rise_C > 10 AS gradual_degradation_signal FROM r""",
        "fjobs",
        "tel",
    ),
)
def degradation(spark, sf_dir):
    """Power peaks and temperature rise in the four hours before every failed job."""
    rows = rca.degradation(views.telemetry(spark, sf_dir), views.fleet_jobs(spark, sf_dir))
    return rows.withColumn("fail_ts", iso("fail_ts"))
