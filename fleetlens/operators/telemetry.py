"""Point, series, snapshot and window reads of the long telemetry table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import codes
from fleetlens.functions.ids import is_ip_named, is_pod_named
from fleetlens.functions.timeutil import on_grid
from fleetlens.plans.intervals import interval_moments, micros, range_join
from fleetlens.plans.scan import ordered_scan


def value_at(telemetry: DataFrame, metric: str, gpu: str, ts: str) -> DataFrame:
    return telemetry.where((F.col("metric") == metric) & (F.col("gpu") == gpu) & (F.col("ts") == F.lit(ts).cast("timestamp"))).select("value")


def snapshot(telemetry: DataFrame, gpu: str, ts: str) -> DataFrame:
    """One row: map of every metric observed on one device at one instant."""
    hit = telemetry.where((F.col("gpu") == gpu) & (F.col("ts") == F.lit(ts).cast("timestamp")) & F.col("value").isNotNull())
    return hit.groupBy("gpu", "ts").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("readings"))


def series(telemetry: DataFrame, metric: str, gpu: str) -> DataFrame:
    hit = telemetry.where((F.col("metric") == metric) & (F.col("gpu") == gpu) & F.col("value").isNotNull())
    return hit.select("ts", "value").orderBy("ts")


def wide_window(telemetry: DataFrame, metrics: Sequence[str], *, gpu: str | None = None, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """One row per device and instant in the inclusive range, one column per metric."""
    hit = telemetry.where(F.col("metric").isin(list(metrics)) & F.col("value").isNotNull())
    if gpu is not None:
        hit = hit.where(F.col("gpu") == gpu)
    if lo is not None:
        hit = hit.where(F.col("ts") >= F.lit(lo).cast("timestamp"))
    if hi is not None:
        hit = hit.where(F.col("ts") <= F.lit(hi).cast("timestamp"))
    return hit.groupBy("gpu", "ts").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )


def observed_gpus(telemetry: DataFrame) -> DataFrame:
    return telemetry.where("value IS NOT NULL").select("gpu").distinct()


def requested_metrics(telemetry: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested metrics with their row counts; one without rows is still listed."""
    wanted = telemetry.sparkSession.createDataFrame([(m,) for m in requested], "metric string")
    counts = telemetry.where(F.col("metric").isin(list(requested)) & F.col("value").isNotNull()).groupBy("metric").agg(F.count("*").alias("n_rows"))
    return wanted.join(counts, "metric", "left").select("metric", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def timestamps(telemetry: DataFrame, gpu: str) -> DataFrame:
    return telemetry.where((F.col("gpu") == gpu) & F.col("value").isNotNull()).select("ts").distinct().orderBy("ts")


def fleet_reading(telemetry: DataFrame, metric: str, ts: str | None = None) -> DataFrame:
    """Every device's reading of one metric at exactly one instant (idle cells left out)."""
    hit = telemetry.where((F.col("metric") == metric) & F.col("value").isNotNull())
    if ts is not None:
        hit = hit.where(F.col("ts") == F.lit(ts).cast("timestamp"))
    return hit.select("gpu", "ts", "value")


def downsample_timestamps(telemetry: DataFrame, stride: int, rows_per_bucket: int | None = None) -> DataFrame:
    """Keep every ``stride``-th distinct timestamp of each metric, all devices together.

    Ranks count only timestamps that carry a kept reading of that metric.
    """
    if stride <= 1:
        return telemetry
    instants = telemetry.where("value IS NOT NULL").select("metric", "ts").distinct()
    counted = instants.select("metric", "ts", micros("ts").alias("_pos"), F.lit(1).cast("bigint").alias("_one"))
    kw = {"rows_per_bucket": rows_per_bucket} if rows_per_bucket else {}
    ranked = ordered_scan(counted, "_pos", {"_rank": ("sum", "_one")}, keys=["metric"], **kw)
    kept = ranked.where((F.col("_rank") - 1) % stride == 0).select("metric", "ts")
    return telemetry.where("value IS NOT NULL").join(kept, ["metric", "ts"], "left_semi")


def resample(telemetry: DataFrame, period_s: int) -> DataFrame:
    """The last reading per device, metric and sampling instant.

    Afterwards a device has at most ``span / period_s`` readings of a metric, however busy
    the source was; joins of windows to readings by device rely on that bound. Readings
    are reduced before the shuffle.
    """
    cell = on_grid("ts", period_s)
    seen = telemetry.where("value IS NOT NULL")
    return (
        seen.groupBy("gpu", "node", "gpu_idx", "metric", cell.alias("_cell"))
        .agg(F.max_by("value", "ts").alias("value"))
        .select(F.col("_cell").alias("ts"), "node", "gpu_idx", "gpu", "metric", "value")
    )


def target_windows(telemetry: DataFrame, targets: DataFrame, metric: str | None = None, *, width_s: int = 360) -> DataFrame:
    """Readings of each target ``(target_id, gpu, lo, hi)`` inside its own closed window."""
    readings = telemetry.where("value IS NOT NULL")
    if metric is not None:
        readings = readings.where(F.col("metric") == metric)
    points = targets.select("target_id", "gpu", micros("lo").alias("_lo"), micros("hi").alias("_hi"))
    samples = readings.select("gpu", "metric", "ts", "value", micros("ts").alias("_at"))
    joined = range_join(points, samples, keys=["gpu"], lo="_lo", hi="_hi", at="_at", width_us=width_s * 1_000_000)
    return joined.select("target_id", "gpu", "metric", "ts", "value")


def window_stats(telemetry: DataFrame, centers: DataFrame, *, metrics: Sequence[str]) -> DataFrame:
    """Fleet-wide stats per ``(lo, hi)`` window and metric: ``samples, mean, max, min``.

    ``samples`` counts timestamps, the rest run over cells; a window without a single
    reading is all zeros, ``samples`` included.
    """
    spans = centers.select(micros("lo").alias("_lo"), micros("hi").alias("_hi")).distinct()
    samples = telemetry.where(F.col("metric").isin(list(metrics))).select("metric", micros("ts").alias("_at"), "value")
    found = interval_moments(spans, samples, lo="_lo", hi="_hi", at="_at", by=["metric"])
    grid = spans.select("_lo", "_hi", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    joined = grid.join(found.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), ["_lo", "_hi", "metric"], "left")
    filled = F.coalesce(F.col("n"), F.lit(0)) > 0
    return joined.select(
        F.timestamp_micros("_lo").alias("lo"),
        F.timestamp_micros("_hi").alias("hi"),
        "metric",
        F.when(filled, F.col("instants")).otherwise(0).cast("bigint").alias("samples"),
        F.when(filled, F.col("mean")).otherwise(0.0).alias("mean"),
        F.when(filled, F.col("high")).otherwise(0.0).alias("max"),
        F.when(filled, F.col("low")).otherwise(0.0).alias("min"),
    )


def populated_cells(telemetry: DataFrame, lo: str, hi: str) -> DataFrame:
    """Non-empty cells per metric in a closed range."""
    inside = telemetry.where(F.col("ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))
    return inside.groupBy("metric").agg(F.count("value").alias("cells"))


def namespace_split(telemetry: DataFrame) -> DataFrame:
    """How many observed devices carry an address name and how many a pod name."""
    return observed_gpus(telemetry).agg(
        F.count("*").alias("n_gpus"),
        F.count_if(is_ip_named("gpu")).alias("ip_named"),
        F.count_if(is_pod_named("gpu")).alias("pod_named"),
    )


def series_summary(telemetry: DataFrame, keys: Sequence[str] = ("gpu", "metric")) -> DataFrame:
    """Min, max and last observed value per series."""
    seen = telemetry.where("value IS NOT NULL")
    return seen.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "ts").alias("last")
    )


def exporter_view(telemetry: DataFrame) -> DataFrame:
    """Readings of the metrics the exporter publishes, keyed by its field names."""
    return telemetry.withColumn("field", codes.metric_field("metric")).where("field IS NOT NULL")


def rename_metrics(telemetry: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Map source metric names onto the canonical vocabulary; others are left out."""
    entries = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    mapped = F.element_at(F.create_map(*entries), F.col("metric")) if entries else F.lit(None)
    return telemetry.where(F.col("metric").isin(list(names))).withColumn("metric", mapped)
