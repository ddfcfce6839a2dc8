"""Streaming queries drained over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import metrics, monitor
from fleetlens.operators import models as model_ops
from fleetlens.operators.onsets import onsets_from_points
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, with_views
from fleetlens.session import materialize, scratch_path
from fleetlens.streaming import feeds
from fleetlens.streaming.onsets import OnsetStream

BIN_S = 7200
STEP_S = 3600
DENSE = 3


def _as_stream(spark, df, name):
    """A derived table's files as a stream."""
    path = scratch_path(spark, f"stream-{name}")
    df.write.parquet(path)
    return feeds.table_stream(spark, path, df.schema)


@query("stream_onsets", with_views(f"SELECT strftime(ts, {ISO}) AS ts, gpu, node, gpu_idx, CAST(code AS INTEGER) AS code FROM ons", "ons"))
def stream_onsets(spark, sf_dir):
    """Live onset detection drained over the whole gauge."""
    detector = OnsetStream(scratch_path(spark, "onset-stream"))
    detector.start(_as_stream(spark, views.gauge(spark, sf_dir), "gauge")).awaitTermination()
    return detector.result(spark).select(iso("ts").alias("ts"), "gpu", "node", "gpu_idx", "code")


@query(
    "stream_counts",
    with_views(
        f"""SELECT strftime(make_timestamp(us - us % {BIN_S * 1000000}), {ISO}) AS window_start, count(*) AS n_onsets FROM ons GROUP BY us - us % {BIN_S * 1000000}
        HAVING us - us % {BIN_S * 1000000} + {BIN_S * 1000000} <= (SELECT max(us) - {2 * STEP_S * 1000000} FROM ons)""",
        "ons",
    ),
)
def stream_counts(spark, sf_dir):
    """Onsets per fixed window; windows the watermark has not passed stay open."""
    stream = _as_stream(spark, views.onsets(spark, sf_dir), "onsets")
    out = feeds.run_to_table(feeds.tumbling_counts(stream, width_s=BIN_S, period_s=STEP_S), scratch_path(spark, "counts"))
    return out.select(iso("window_start").alias("window_start"), "n_onsets")


@query(
    "stream_sliding_counts",
    with_views(
        f"""WITH w AS (SELECT (us - us % {STEP_S * 1000000}) - i * {STEP_S * 1000000} AS start FROM ons, (SELECT unnest(range(6)) AS i))
        SELECT strftime(make_timestamp(start), {ISO}) AS window_start, count(*) AS n_onsets FROM w GROUP BY start
        HAVING start + {6 * STEP_S * 1000000} <= (SELECT max(us) - {2 * STEP_S * 1000000} FROM ons)""",
        "ons",
    ),
)
def stream_sliding_counts(spark, sf_dir):
    """Onsets per six-hour window sliding by the hour."""
    stream = _as_stream(spark, views.onsets(spark, sf_dir), "onsets")
    out = feeds.run_to_table(feeds.sliding_counts(stream, width_s=6 * STEP_S, period_s=STEP_S), scratch_path(spark, "sliding"))
    return out.select(iso("window_start").alias("window_start"), "n_onsets")


@query(
    "stream_dense_runs",
    with_views(
        f"""WITH d AS (SELECT us, count(*) AS n FROM gons GROUP BY us HAVING count(*) >= {DENSE}),
        g AS (SELECT us, n, CASE WHEN us - lag(us) OVER (ORDER BY us) <= {2 * STEP_S * 1000000} THEN 0 ELSE 1 END AS brk FROM d),
        r AS (SELECT *, sum(brk) OVER (ORDER BY us) AS run FROM g)
        SELECT 'fleet' AS cluster, strftime(make_timestamp(min(us)), {ISO}) AS first_ts, strftime(make_timestamp(max(us)), {ISO}) AS last_ts, count(*) AS samples, CAST(sum(n) AS BIGINT) AS n_onsets
        FROM r GROUP BY run HAVING max(us) + {3 * STEP_S * 1000000} - 1 <= (SELECT max(us) - {2 * STEP_S * 1000000} FROM ons)""",
        "gons",
    ),
)
def stream_dense_runs(spark, sf_dir):
    """Runs of dense hourly samples found on the stream."""
    rows = views.onsets(spark, sf_dir).withColumn("cluster", F.lit("fleet"))
    stream = _as_stream(spark, rows, "runs")
    out = feeds.run_to_table(feeds.dense_runs(stream, threshold=DENSE, period_s=STEP_S, gap_s=2 * STEP_S), scratch_path(spark, "runs"))
    return out.select("cluster", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"), "samples", "n_onsets")


@query(
    "stream_feed",
    with_views(
        "SELECT DISTINCT gpu || '@' || us AS id, gpu, CAST(code AS INTEGER) AS code, 'events' AS data_source FROM ons", "ons"
    ),
)
def stream_feed(spark, sf_dir):
    """The incident feed with every item delivered twice and kept once, badged with its source."""
    rows = views.onsets(spark, sf_dir).select(F.concat_ws("@", "gpu", F.unix_micros("ts")).alias("id"), "ts", "gpu", "code")
    stream = _as_stream(spark, rows.unionByName(rows), "feed")
    once = feeds.badge(feeds.without_duplicates(stream, "ts", "1 hour"), "events")
    return feeds.run_to_table(once, scratch_path(spark, "feed")).drop("ts")


@query("stream_scores")
def stream_scores(spark, sf_dir):
    """Points scored on arrival by a fitted model, against a threshold calibrated on the earlier rows."""
    features = ("GPU_TEMP_mean", "POWER_USAGE_max", "GPU_UTIL_last")
    rows = materialize(
        metrics.time_ordered_split(views.points(spark, sf_dir).select("gpu", "node", "gpu_idx", "t_ref", "horizon_s", "label", *features)), "stream-split"
    )
    train = rows.where("is_train")
    model = model_ops.fit(train, model_ops.Candidate("logreg", features))
    level = monitor.thresholds(model_ops.score(model, train).select("score"), [0.05]).first()["threshold"]
    stream = _as_stream(spark, rows.where(~F.col("is_train")).drop("is_train"), "points")
    out = feeds.run_to_table(feeds.score_stream(stream, model, level, 1), scratch_path(spark, "scores"))
    return out.select("gpu", iso("t_ref").alias("t_ref"), "horizon_s", F.round("score", 6).alias("score"), "alert_flag", "model_version")


@query("stream_misses")
def stream_misses(spark, sf_dir):
    """Onsets joined to the alerts before them on two streams."""
    rows = views.scored(spark, sf_dir).select("gpu", "t_ref", "horizon_s", "label", "score")
    flagged = monitor.score_flags(rows, monitor.thresholds(rows, [0.05])).select("gpu", "t_ref", "alert_flag").distinct()
    alerts = _as_stream(spark, flagged, "alerts")
    onset = _as_stream(spark, onsets_from_points(rows), "miss-onsets")
    out = feeds.run_to_table(feeds.miss_stream(alerts, onset, horizon_s=43200, delay="2 hours"), scratch_path(spark, "misses"))
    return out.select("gpu", iso("onset_ts").alias("onset_ts"), iso("alert_ts").alias("alert_ts"), "caught")
