"""Labelled prediction points with windowed features, free of future leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ids import index_of, node_of
from fleetlens.plans.intervals import MICROS, exists_within, micros, range_join
from fleetlens.schemas import POINT_META, WINDOW_STATS, feature_columns

DEFAULT_METRICS = ("GPU_TEMP", "POWER_USAGE", "GPU_UTIL", "MEMORY_TEMP")
EVENT_SOURCE = "XID_ERRORS"


def candidates(
    onset_rows: DataFrame,
    *,
    horizons_s: Sequence[float],
    neg_offset_s: float = 3600.0,
    control_gpus: Sequence[str] = (),
) -> DataFrame:
    """Distinct ``(gpu, t_ref, horizon_s)`` with ``positive`` and the true label.

    Positives sit ``horizon_s`` before an onset; negatives ``neg_offset_s`` before it on
    the same device, and at every positive time on each control device. A negative whose
    horizon holds an onset is dropped.
    """
    h = F.explode(F.array(*[F.lit(float(x)) for x in horizons_s])).alias("horizon_s")
    base = onset_rows.select("gpu", micros("ts").alias("_t")).distinct().select("gpu", "_t", h)
    shift = (F.col("horizon_s") * MICROS).cast("bigint")
    positives = base.select("gpu", (F.col("_t") - shift).alias("_ref"), "horizon_s", F.lit(True).alias("positive"))
    negatives = base.select(
        "gpu", (F.col("_t") - int(neg_offset_s * MICROS)).alias("_ref"), "horizon_s", F.lit(False).alias("positive")
    )
    pool = positives.unionByName(negatives)
    if control_gpus:
        # one row per control device (a parameter list) and distinct positive time
        times = positives.select("_ref", "horizon_s").distinct()
        controls = times.select(
            F.explode(F.array(*[F.lit(g) for g in control_gpus])).alias("gpu"),
            "_ref",
            "horizon_s",
            F.lit(False).alias("positive"),
        )
        pool = pool.unionByName(controls)
    unique = pool.groupBy("gpu", "_ref", "horizon_s").agg(F.bool_or("positive").alias("positive"))
    spans = [int(x * MICROS) for x in horizons_s]
    labelled = exists_within(
        unique.withColumn("_span", (F.col("horizon_s") * MICROS).cast("bigint")),
        onset_rows.select("gpu", micros("ts").alias("_at")),
        keys=["gpu"],
        start="_ref",
        at="_at",
        spans_us=spans,
        span="_span",
        after_start=True,
        out="_hit",
    )
    kept = labelled.where(F.col("positive") | ~F.col("_hit"))
    return kept.select(
        "gpu",
        F.timestamp_micros("_ref").alias("t_ref"),
        "horizon_s",
        "positive",
        F.col("_hit").cast("int").alias("label"),
    )


def _stat_columns(metric: str, lookback_s: float, period_s: float) -> list[Column]:
    """The ten statistics of one metric over the rows of a point's window."""
    here = F.col("metric") == metric
    v = F.when(here, F.col("value"))
    at = F.when(here, F.col("_at"))
    n = F.count(v)
    expected = lookback_s / period_s + 1.0 if period_s > 0 else 0.0
    last, first = F.max_by(v, at), F.min_by(v, at)
    slope = F.regr_slope(v, F.when(here, (F.col("_at") - F.col("_ref")) / F.lit(1e6)))
    stats = {
        "count": n,
        "coverage": (n / F.lit(expected)) if expected > 0 else F.lit(0.0),
        "present": (n > 0).cast("int"),
        "mean": F.avg(v),
        "std": F.stddev_pop(v),
        "min": F.min(v),
        "max": F.max(v),
        "last": last,
        "delta": last - first,
        "slope": slope,
    }
    return [stats[s].alias(f"{metric}_{s}") for s in WINDOW_STATS]


def window_features(
    points: DataFrame,
    telemetry: DataFrame,
    metrics: Sequence[str],
    *,
    lookback_s: float,
    period_s: float = 15.0,
) -> DataFrame:
    """Features over ``[t_ref - lookback, t_ref]`` for each distinct ``(gpu, t_ref)``.

    One join on device and time bucket, then one aggregation that computes every metric's
    statistics; points without a reading in any metric give no row. Missing statistics are
    NULL, counts and coverage of an empty metric are 0.
    """
    span = int(lookback_s * MICROS)
    probes = points.select("gpu", micros("t_ref").alias("_ref")).distinct().withColumn("_lo", F.col("_ref") - span)
    samples = telemetry.where(F.col("metric").isin(list(metrics)) & F.col("value").isNotNull()).select(
        "gpu", "metric", micros("ts").alias("_at"), "value"
    )
    joined = range_join(probes.hint("merge"), samples, keys=["gpu"], lo="_lo", hi="_ref", at="_at", width_us=span)
    stats = [c for m in metrics for c in _stat_columns(m, lookback_s, period_s)]
    return joined.groupBy("gpu", "_ref").agg(*stats).withColumn("t_ref", F.timestamp_micros("_ref")).drop("_ref")


def labelled_points(
    gauge_onsets: DataFrame,
    telemetry: DataFrame,
    *,
    metrics: Sequence[str] = DEFAULT_METRICS,
    horizons_s: Sequence[float],
    lookback_s: float,
    neg_offset_s: float = 3600.0,
    control_gpus: Sequence[str] = (),
    period_s: float = 15.0,
) -> DataFrame:
    """The labelled dataset: meta columns, then features in name order."""
    points = candidates(
        gauge_onsets, horizons_s=horizons_s, neg_offset_s=neg_offset_s, control_gpus=control_gpus
    )
    # horizons sharing a device and time share its window: it is computed once and joined back
    feats = window_features(points, telemetry, metrics, lookback_s=lookback_s, period_s=period_s)
    rows = points.drop("positive").join(feats, ["gpu", "t_ref"])
    full = (
        rows.withColumn("node", node_of("gpu"))
        .withColumn("gpu_idx", index_of("gpu"))
        .withColumn("event_source", F.lit(EVENT_SOURCE))
        .withColumn("lookback_s", F.lit(float(lookback_s)))
    )
    return full.select(*POINT_META, *sorted(feature_columns(full.columns)))


def profile(points: DataFrame) -> DataFrame:
    """Rows, positives, devices, features and base rate of a labelled table."""
    return points.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("n_positive"),
        F.count_distinct("gpu").alias("n_gpus"),
        F.lit(len(feature_columns(points.columns))).alias("n_features"),
        F.avg(F.col("label").cast("double")).alias("base_rate"),
    )
