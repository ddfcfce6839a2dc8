"""Labelled prediction points."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import features as ops
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, with_views


@query(
    "point_candidates",
    with_views(f"SELECT gpu, strftime(make_timestamp(ref), {ISO}) AS t_ref, horizon_s, CAST(positive = 1 AS INTEGER) AS positive, label FROM cand", "cand"),
)
def point_candidates(spark, sf_dir):
    """Positives, same-device negatives and time-matched controls after the leakage guard."""
    rows = ops.candidates(
        views.onsets(spark, sf_dir), horizons_s=views.HORIZONS_S, neg_offset_s=views.NEG_OFFSET_S, control_gpus=views.CONTROL_GPUS
    )
    return rows.select("gpu", iso("t_ref").alias("t_ref"), "horizon_s", F.col("positive").cast("int").alias("positive"), "label")


_ROUND = {f"{m}_{s}": d for m in views.FEATURE_METRICS for s, d in (("coverage", 9), ("mean", 9), ("std", 9), ("delta", 9), ("slope", 12))}


def labelled(spark, sf_dir):
    return ops.labelled_points(
        views.onsets(spark, sf_dir),
        views.telemetry(spark, sf_dir),
        metrics=views.FEATURE_METRICS,
        horizons_s=views.HORIZONS_S,
        lookback_s=views.LOOKBACK_S,
        neg_offset_s=views.NEG_OFFSET_S,
        control_gpus=views.CONTROL_GPUS,
        period_s=views.PERIOD_S,
    )


@query(
    "labelled_points",
    with_views(
        f"SELECT * EXCLUDE (ref) REPLACE ({', '.join(f'round({c}, {d}) AS {c}' for c, d in _ROUND.items())}), strftime(make_timestamp(ref), {ISO}) AS t_ref FROM pts", "pts"
    ),
)
def labelled_points(spark, sf_dir):
    """The whole labelled dataset with ten features per metric."""
    rows = labelled(spark, sf_dir)
    return rows.select(*[iso(c).alias(c) if c == "t_ref" else F.round(c, _ROUND[c]).alias(c) if c in _ROUND else F.col(c) for c in rows.columns])


@query(
    "dataset_profile",
    with_views(
        f"""SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive, count(DISTINCT gpu) AS n_gpus, {10 * len(views.FEATURE_METRICS)} AS n_features,
        round(avg(label), 9) AS base_rate FROM pts""",
        "pts",
    ),
)
def dataset_profile(spark, sf_dir):
    return ops.profile(views.points(spark, sf_dir)).withColumn("base_rate", F.round("base_rate", 9))


@query(
    "feature_coverage",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, CAST(sum({m}_present) AS BIGINT) AS present, round(avg({m}_coverage), 6) AS coverage FROM pts" for m in views.FEATURE_METRICS
        ),
        "pts",
    ),
)
def feature_coverage(spark, sf_dir):
    """Points with a reading and mean window coverage per metric."""
    rows = views.points(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_present").alias("p"), F.col(f"{m}_coverage").alias("c")) for m in views.FEATURE_METRICS])
    long = rows.select(F.explode(pairs).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.sum("p").alias("present"), F.round(F.avg("c"), 6).alias("coverage"))


