"""Onset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import character, onsets
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, with_views

_MEANING = """CASE code WHEN 43 THEN 'GPU stopped processing (fell off bus / hang)' WHEN 31 THEN 'GPU memory page fault (MMU / illegal address)'
 WHEN 45 THEN 'Preemptive cleanup (robust channel; often app-induced)' WHEN 94 THEN 'Contained ECC error' ELSE 'unknown' END"""
_GROUP = """CASE code WHEN 43 THEN 'fatal_hang' WHEN 31 THEN 'memory_fault' WHEN 45 THEN 'soft_cleanup' WHEN 94 THEN 'contained_ecc' ELSE 'unknown' END"""


@query(
    "onset_codes",
    with_views(f"SELECT CAST(code AS INTEGER) AS code, count(*) AS events, {_MEANING} AS meaning, {_GROUP} AS code_group FROM ons GROUP BY code", "ons"),
)
def onset_codes(spark, sf_dir):
    """Onsets per fault code with meaning and group, straight from the gauge."""
    return character.by_code(onsets.onsets(views.gauge(spark, sf_dir)))


def _rows(df):
    return df.select(iso("ts").alias("ts"), "gpu", "node", "gpu_idx", "code")


_ROW_SQL = f"SELECT strftime(ts, {ISO}) AS ts, gpu, node, gpu_idx, CAST(code AS INTEGER) AS code FROM ons"


@query("onsets", with_views(_ROW_SQL, "ons"))
def onset_rows(spark, sf_dir):
    return _rows(onsets.onsets(views.gauge(spark, sf_dir)))


@query("onset_times", with_views(f"SELECT strftime(ts, {ISO}) AS ts, gpu FROM ons", "ons"))
def onset_times(spark, sf_dir):
    return onsets.onsets(views.gauge(spark, sf_dir)).select(iso("ts").alias("ts"), "gpu")


@query(
    "strict_onsets",
    with_views(
        f"""WITH seen AS (SELECT *, lag(code) OVER (PARTITION BY gpu ORDER BY ts) AS prev FROM gauge WHERE code IS NOT NULL)
        SELECT strftime(ts, {ISO}) AS ts, gpu, node, gpu_idx, CAST(code AS INTEGER) AS code FROM seen WHERE code <> 0 AND prev = 0""",
        "gauge",
    ),
)
def strict_onset_rows(spark, sf_dir):
    return _rows(onsets.strict_onsets(views.gauge(spark, sf_dir)))


@query(
    "left_censored",
    with_views("SELECT CAST(count(*) FILTER (WHERE code <> 0) AS BIGINT) AS left_censored FROM gauge WHERE ts = (SELECT min(ts) FROM gauge)", "gauge"),
)
def left_censored(spark, sf_dir):
    return onsets.left_censored(views.gauge(spark, sf_dir))


@query(
    "faulted_at_first_cell",
    with_views(
        """WITH f AS (SELECT gpu, code, row_number() OVER (PARTITION BY gpu ORDER BY ts) AS rn FROM gauge)
        SELECT count(*) FILTER (WHERE code <> 0) AS gpus_faulted_at_start, count(*) AS gpus FROM f WHERE rn = 1""",
        "gauge",
    ),
)
def faulted_at_first_cell(spark, sf_dir):
    return onsets.faulted_at_first_cell(views.gauge(spark, sf_dir))


_SPAN = f"SELECT strftime(min(ts), {ISO}) AS first_ts, strftime(max(ts), {ISO}) AS last_ts, (max(us) - min(us)) / 1000000.0::DOUBLE AS span_seconds FROM gauge"


def _span(df):
    return df.select(iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"), "span_seconds")


@query("sample_span", with_views(_SPAN, "gauge"))
def sample_span(spark, sf_dir):
    return _span(onsets.sample_span(views.gauge(spark, sf_dir)))


@query("populated_span", with_views(_SPAN + " WHERE code IS NOT NULL", "gauge"))
def populated_span(spark, sf_dir):
    return _span(onsets.populated_span(views.gauge(spark, sf_dir)))


@query(
    "onsets_from_points",
    with_views(
        f"SELECT DISTINCT gpu, strftime(make_timestamp(ref + CAST(horizon_s * 1000000 AS BIGINT)), {ISO}) AS ts FROM pts WHERE label = 1", "pts"
    ),
)
def onsets_from_points(spark, sf_dir):
    return onsets.onsets_from_points(views.points(spark, sf_dir)).select("gpu", iso("ts").alias("ts"))


@query(
    "affected_gpus",
    with_views(
        f"SELECT DISTINCT gpu FROM gons WHERE us IN (SELECT us FROM gons GROUP BY us HAVING count(*) >= 5)", "gons"
    ),
)
def affected_gpus(spark, sf_dir):
    rows = views.grid_onsets(spark, sf_dir)
    dense = character.sample_counts(rows).where(F.col("n_onsets") >= 5)
    return onsets.affected_gpus(rows, dense)
