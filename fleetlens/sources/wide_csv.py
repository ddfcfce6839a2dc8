"""Wide metric text (``Time`` plus one column per device) to long rows.

The text route keeps three cell states apart: an empty cell is a row with a NULL value,
``0`` is a reading, and a cell missing from a short line is no row at all.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.timeutil import relative_bounds, strict_instant, strict_relative_seconds, window_bounds
from fleetlens.sources.wide_source import WideReader, register


def check_header(line: str | None, source: str) -> list[str]:
    """Header cells of a wide source; anything but ``Time`` plus a device column fails."""
    cells = (line or "").rstrip("\r\n").split(",")
    if cells[0] != "Time" or len(cells) < 2:
        raise ValueError(f"not a wide time-series source (need 'Time' and at least one device column): {source}")
    return cells


def read_wide(
    spark: SparkSession,
    path: str,
    metric: str,
    *,
    time_range: tuple[str, str] | None = None,
    gpus: Collection[str] | None = None,
    alias: Mapping[str, str] | None = None,
    keep_empty: bool = False,
    origin: str | None = None,
) -> DataFrame:
    """Long rows ``(ts, node, gpu_idx, gpu, metric, value)`` of one wide source.

    ``path`` may be a file, folder or glob; every file begins with a header line of its
    own. ``time_range`` is inclusive; ``gpus=None`` keeps every device and an empty
    collection keeps none. ``keep_empty`` retains idle cells as NULL values (fault detection
    needs them). Times in relative seconds are placed after ``origin``; without one they
    fail the job. All of these reach the scan, see :mod:`fleetlens.sources.wide_source`.
    """
    register(spark)
    WideReader({"path": path, "alias": json.dumps(dict(alias or {}))}).partitions()  # a file without a header fails here
    reader = spark.read.format("widecsv").option("alias", json.dumps(dict(alias or {})))
    long = (reader.option("origin", origin) if origin else reader).load(path)
    if time_range is not None:
        long = long.where(F.col("ts").between(*[F.to_timestamp(F.lit(t)) for t in time_range]))
    if gpus is not None:
        long = long.where(F.col("gpu").isin(list(gpus)))
    if not keep_empty:
        long = long.where(F.col("value").isNotNull())
    return long.select("ts", "node", "gpu_idx", "gpu", F.lit(metric).alias("metric"), "value")


def text_window_stats(spark: SparkSession, path: str, center: str | float, window_s: float) -> DataFrame:
    """``samples, mean, max, min`` over all cells within ``center ± window_s`` of one wide source.

    Reads relative-second and ISO times alike (a number as ``center`` selects the first) and
    needs no device names. An unreadable time fails the job; without a reading all four are 0.
    """
    body = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))
    body = body.where((F.trim("line") != "") & ~F.col("line").startswith("Time,"))
    parts = body.select(F.split("line", ",", -1).alias("cells"))
    when = F.get("cells", F.lit(0))
    timed = parts.select(strict_instant(when).alias("ts"), strict_relative_seconds(when).alias("rel"), "cells")
    if isinstance(center, (int, float)):
        lo, hi = relative_bounds(F.lit(float(center)), window_s)
        inside = timed.where(F.coalesce(F.col("rel").between(lo, hi), F.lit(False)))
    else:
        lo, hi = window_bounds(F.to_timestamp(F.lit(center)), window_s)
        inside = timed.where(F.coalesce(F.col("ts").between(lo, hi), F.lit(False)))
    filled = F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda c: c != "")
    values = inside.select(F.transform(filled, lambda c: c.cast("double")).alias("v"))
    sums = values.agg(
        F.count("*").alias("rows"),
        F.sum(F.size("v")).alias("n"),
        F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"),
        F.max(F.array_max("v")).alias("high"),
        F.min(F.array_min("v")).alias("low"),
    )
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    return sums.select(
        F.when(some, F.col("rows")).otherwise(0).cast("bigint").alias("samples"),
        F.when(some, F.col("total") / F.col("n")).otherwise(0.0).alias("mean"),
        F.when(some, F.col("high")).otherwise(0.0).alias("max"),
        F.when(some, F.col("low")).otherwise(0.0).alias("min"),
    )


def fleet_size(spark: SparkSession, path: str) -> int:
    """Device columns in the header."""
    first = spark.read.text(path).first()
    return len(check_header(first.value if first else None, path)) - 1


def read_gauge(spark: SparkSession, path: str) -> DataFrame:
    """Fault gauge with idle cells kept: ``(ts, node, gpu_idx, gpu, code)``."""
    return read_wide(spark, path, "XID_ERRORS", keep_empty=True).select(
        "ts", "node", "gpu_idx", "gpu", F.col("value").alias("code")
    )


def load_metrics(
    spark: SparkSession,
    sources: Mapping[str, str],
    *,
    time_range: tuple[str, str] | None = None,
    gpus: Collection[str] | None = None,
    downsample: int | None = None,
    alias: Mapping[str, str] | None = None,
) -> DataFrame:
    """All requested metrics as one long table (empty cells skipped)."""
    from fleetlens.operators.telemetry import downsample_timestamps

    out = None
    for metric, path in sources.items():
        part = read_wide(spark, path, metric, time_range=time_range, gpus=gpus, alias=alias)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no metric sources given")
    return downsample_timestamps(out, downsample) if downsample and downsample > 1 else out


def write_telemetry(long: DataFrame, path: str, mode: str = "append") -> None:
    """Long table as Parquet by metric and day, time-sorted inside files for row-group pruning."""
    dated = long.withColumn("date", F.to_date("ts"))
    (
        dated.repartition("metric", "date", F.pmod(F.xxhash64("gpu"), F.lit(16)))
        .sortWithinPartitions("metric", "date", "ts")
        .write.mode(mode)
        .partitionBy("metric", "date")
        .parquet(path)
    )
