"""Job history: replay order, design matrices, telemetry per job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.codes import FAIL_STATES
from fleetlens.plans.intervals import interval_moments, micros
from fleetlens.plans.scan import ordered_scan

JOB_PREFIXES = ("power_", "temp_", "util_")
SOP_FEATURES = ("power_spike_ratio", "temp_rise_C", "correlated_count")


def warm_start(history: DataFrame, n_failures: int, order: str, **kw) -> DataFrame:
    """Rows up to and including the ``n_failures``-th failure in ``order``; all rows if there are fewer."""
    failed = history.select(order, F.col("state").isin(list(FAIL_STATES)).cast("bigint").alias("_f"))
    counted = ordered_scan(failed, order, {"_c": ("sum", "_f")}, **kw)
    cut = counted.where((F.col("_f") == 1) & (F.col("_c") == n_failures)).agg(F.min(order)).scalar()
    return history.where(F.coalesce(F.col(order) <= cut, F.lit(True)))


def replay_from(history: DataFrame, start: int, order: str, **kw) -> DataFrame:
    """Rows from position ``start`` (0-based) on in ``order``."""
    one = history.select(order, F.lit(1).cast("bigint").alias("_one"))
    placed = ordered_scan(one, order, {"_pos": ("sum", "_one")}, **kw)
    first = placed.where(F.col("_pos") > start).agg(F.min(order)).scalar()
    return history.where(F.coalesce(F.col(order) >= first, F.lit(False)))


def design_matrix(history: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns plus ``label`` (1 = failed state); ``type`` becomes one 0/1 column per value.

    A feature the history lacks is an error.
    """
    missing = [f for f in features if f not in history.columns]
    if missing:
        raise KeyError(f"unknown feature: {missing}")
    cols = [F.col(f) for f in features if f != "type"]
    if "type" in features:
        values = sorted(r[0] for r in history.select("type").where("type IS NOT NULL").distinct().collect())  # as many as columns come out
        cols += [F.coalesce((F.col("type") == v).cast("int"), F.lit(0)).alias(f"type_{v}") for v in values]
    label = F.col("state").isin(list(FAIL_STATES)).cast("int").alias("label")
    return history.select(*keep, *cols, label)


def sop_matrix(sop: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Telemetry signals of memory entries that carry metrics; restart dispositions are 0, others 1."""
    restart = F.lower(F.coalesce("disposition", F.lit(""))).isin("restart_and_watch", "restart")
    return sop.where("metrics IS NOT NULL").select(
        *keep,
        *[F.coalesce(F.col(f"metrics.{f}").cast("double"), F.lit(0.0)).alias(f) for f in SOP_FEATURES],
        F.when(restart, 0).otherwise(1).alias("label"),
    )


def job_features(jobs: DataFrame, telemetry: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Mean, max and population std of every reading fleet-wide during each job, zeros when there is none.

    ``jobs`` has ``start_ts, end_ts``; ``metrics`` maps output prefixes to metric names.
    Jobs sharing an interval are computed once; see :func:`interval_moments`.
    """
    spans = jobs.select(micros("start_ts").alias("_lo"), micros("end_ts").alias("_hi"))
    samples = telemetry.where(F.col("metric").isin(list(metrics.values()))).select("metric", micros("ts").alias("_at"), "value")
    found = interval_moments(spans, samples, lo="_lo", hi="_hi", at="_at", by=["metric"])
    mean, std = F.col("mean"), F.sqrt(F.col("m2") / F.col("n"))
    filled = F.col("n") > 0
    wide = found.groupBy("lo", "hi").agg(
        *[
            F.max(F.when((F.col("metric") == m) & filled, expr)).alias(f"{name}_{stat}")
            for name, m in metrics.items()
            for stat, expr in (("mean", mean), ("max", F.col("high")), ("std", std))
        ]
    )
    keyed = jobs.withColumn("lo", micros("start_ts")).withColumn("hi", micros("end_ts")).join(wide, ["lo", "hi"], "left")
    stats = [f"{name}_{stat}" for name in metrics for stat in ("mean", "max", "std")]
    return keyed.select(*jobs.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in stats])


def sensory(job_features_rows: DataFrame, job_id: str) -> DataFrame:
    """Telemetry columns of one job."""
    cols = [c for c in job_features_rows.columns if c.startswith(JOB_PREFIXES)]
    return job_features_rows.where(F.col("job_id").cast("string") == job_id).select(*cols)
