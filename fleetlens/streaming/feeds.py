"""Feeds: replay, badges, duplicate-free delivery, windowed counts, scores and misses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.models import score

SAMPLE_SECONDS = 15
LATE_SAMPLES = 2


def late_delay(period_s: int = SAMPLE_SECONDS) -> str:
    """How long a window waits for late rows: two sample periods."""
    return f"{LATE_SAMPLES * period_s} seconds"


def table_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per micro-batch if asked."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def badge(feed: DataFrame, source: str) -> DataFrame:
    """Mark every item with where its data comes from."""
    return feed.withColumn("data_source", F.lit(source))


def without_duplicates(feed: DataFrame, time: str, delay: str, key: str = "id") -> DataFrame:
    """Each id once; ids are remembered until the watermark passes them."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(onset_stream: DataFrame, *, width_s: int = 300, period_s: int = SAMPLE_SECONDS) -> DataFrame:
    """Onsets per fixed window."""
    return (
        onset_stream.withWatermark("ts", late_delay(period_s))
        .groupBy(F.window("ts", f"{width_s} seconds"))
        .agg(F.count("*").alias("n_onsets"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_onsets")
    )


def sliding_counts(onset_stream: DataFrame, *, width_s: int = 90, period_s: int = SAMPLE_SECONDS) -> DataFrame:
    """Onsets per sliding window, one step per sample (half-open, unlike the batch cohort)."""
    return (
        onset_stream.withWatermark("ts", late_delay(period_s))
        .groupBy(F.window("ts", f"{width_s} seconds", f"{period_s} seconds"))
        .agg(F.count("*").alias("n_onsets"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_onsets")
    )


def dense_runs(onset_stream: DataFrame, *, threshold: int = 40, period_s: int = SAMPLE_SECONDS, gap_s: int | None = None, cluster: str = "cluster") -> DataFrame:
    """Runs of consecutive dense samples per cluster: a count per sample, then a session over dense ones."""
    gap = f"{gap_s or period_s} seconds"
    per_sample = (
        onset_stream.withWatermark("ts", late_delay(period_s))
        .groupBy(F.window("ts", f"{period_s} seconds"), cluster)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= threshold)
        .select(cluster, F.window_time("window").alias("at"), F.col("window.start").alias("sample"), "n")
    )
    return (
        per_sample.groupBy(F.session_window("at", gap), cluster)
        .agg(F.min("sample").alias("first_ts"), F.max("sample").alias("last_ts"), F.count("*").alias("samples"), F.sum("n").alias("n_onsets"))
        .select(cluster, "first_ts", "last_ts", "samples", "n_onsets")
    )


def score_stream(points: DataFrame, model: PipelineModel, threshold: float, version: int) -> DataFrame:
    """Score rows as they arrive and flag them against a fixed threshold."""
    scored = score(model, points, version=version)
    return scored.withColumn("alert_flag", F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False)))


def miss_stream(alerts: DataFrame, onset_stream: DataFrame, *, horizon_s: int, delay: str) -> DataFrame:
    """Onsets with each alert in ``[t - H, t)``; an onset none preceded comes once, with NULLs.

    A left outer interval join of two watermarked streams; misses appear after the
    watermark has passed their window.
    """
    a = alerts.where("alert_flag").select(F.col("gpu").alias("alert_gpu"), F.col("t_ref").alias("alert_ts")).withWatermark("alert_ts", delay)
    o = onset_stream.select("gpu", F.col("ts").alias("onset_ts")).withWatermark("onset_ts", delay)
    cond = (
        (F.col("gpu") == F.col("alert_gpu"))
        & (F.col("alert_ts") >= F.col("onset_ts") - F.expr(f"INTERVAL {int(horizon_s)} SECONDS"))
        & (F.col("alert_ts") < F.col("onset_ts"))
    )
    return o.join(a, cond, "left_outer").select("gpu", "onset_ts", "alert_ts", F.col("alert_ts").isNotNull().alias("caught"))


def run_to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a Parquet folder and return it as a batch table."""
    path = f"{root.rstrip('/')}/out"
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def retrain_on_misses(miss_rows: DataFrame, trainer: Callable[[], object], root: str, *, min_misses: int = 1) -> StreamingQuery:
    """Call ``trainer`` after every micro-batch that brings enough misses."""

    def react(rows: DataFrame, batch_id: int) -> None:
        if rows.where(~F.col("caught")).limit(min_misses).count() >= min_misses:
            trainer()

    return (
        miss_rows.writeStream.foreachBatch(react)
        .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
