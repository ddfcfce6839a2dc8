"""Fault onsets of the gauge and what surrounds them.

A gauge row is one cell: NULL code = idle device, 0 = healthy, other = latched fault.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.timeutil import plus_seconds
from fleetlens.plans.edges import CHUNK_SECONDS, rising_edges
from fleetlens.plans.intervals import micros


def onsets(gauge: DataFrame, *, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Empty-aware onsets: a fault whose previous cell was healthy or idle.

    A device whose first cell is already faulted is left-censored, a fault that stays or
    changes code without clearing is not a new onset. Cells of one device and instant (files
    that overlap) count as idle first, then by code.
    """
    timed = gauge.withColumn("_at", micros("ts"))
    edges = rising_edges(timed, F.col("code") != 0, key=["gpu"], at="_at", then=["code"], chunk_seconds=chunk_seconds)
    return edges.select("ts", "gpu", "node", "gpu_idx", F.col("code").cast("int").alias("code"))


def strict_onsets(gauge: DataFrame, *, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Onsets over populated cells only: the previous *observed* reading was exactly 0."""
    return onsets(gauge.where("code IS NOT NULL"), chunk_seconds=chunk_seconds)


def left_censored(gauge: DataFrame) -> DataFrame:
    """Devices already faulted at the trace's first sample."""
    start = gauge.agg(F.min("ts")).scalar()
    return gauge.where(F.col("ts") == start).agg(F.count_if(F.col("code") != 0).alias("left_censored"))


def faulted_at_first_cell(gauge: DataFrame) -> DataFrame:
    """Devices whose own first cell is a fault (none of them counts as an onset there)."""
    first = gauge.groupBy("gpu").agg(F.min_by("code", "ts").alias("code"))
    return first.agg(F.count_if(F.col("code") != 0).alias("gpus_faulted_at_start"), F.count("*").alias("gpus"))


def sample_span(gauge: DataFrame) -> DataFrame:
    """First and last sample and the seconds between, whatever the cells hold."""
    return gauge.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn(
        "span_seconds", (micros("last_ts") - micros("first_ts")) / 1e6
    )


def populated_span(gauge: DataFrame) -> DataFrame:
    """Span over populated cells only."""
    return sample_span(gauge.where("code IS NOT NULL"))


def onsets_from_points(points: DataFrame) -> DataFrame:
    """Onsets recovered from a labelled table: a positive lies ``horizon_s`` before its onset."""
    for needed in ("label", "horizon_s"):
        if needed not in points.columns:
            raise ValueError("points must carry 'label' and 'horizon_s' to recover onsets")
    return (
        points.where("label = 1").select("gpu", plus_seconds("t_ref", "horizon_s").alias("ts")).distinct()
    )


def affected_gpus(onset_rows: DataFrame, samples: Sequence[str] | DataFrame) -> DataFrame:
    """Distinct devices with an onset at one of the given samples (times, or a frame with ``ts``)."""
    if isinstance(samples, DataFrame):
        hit = onset_rows.join(samples.select("ts").distinct(), "ts", "left_semi")
    else:
        hit = onset_rows.where(F.col("ts").isin([F.lit(s).cast("timestamp") for s in samples]))
    return hit.select("gpu").distinct()
