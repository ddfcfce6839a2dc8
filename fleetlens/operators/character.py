"""How often faults occur, when they cluster, and what sensors did before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.codes import with_code_attributes
from fleetlens.functions.timeutil import TRACE_OFFSET, local_day
from fleetlens.plans.intervals import MICROS, bucket_of, micros, range_join
from fleetlens.plans.scan import exact_medians, order_statistics
from fleetlens.session import materialize

CHUNK_SECONDS = 3600


def by_code(onset_rows: DataFrame) -> DataFrame:
    """Onsets per code with meaning and group, most frequent first."""
    counted = onset_rows.groupBy("code").agg(F.count("*").alias("events"))
    return (
        with_code_attributes(counted)
        .select("code", "events", "meaning", "code_group")
        .orderBy(F.desc("events"), "code")
    )


def frequency(onset_rows: DataFrame, n_gpus: int | DataFrame, span_seconds: float | DataFrame) -> DataFrame:
    """Totals, observed device-hours (1 dp), device-hours per event (1 dp), events per device-hour (6 dp).

    ``n_gpus`` and ``span_seconds`` are numbers or one-cell frames.
    """
    gpus = n_gpus.scalar() if isinstance(n_gpus, DataFrame) else F.lit(n_gpus)
    span = span_seconds.scalar() if isinstance(span_seconds, DataFrame) else F.lit(float(span_seconds))
    totals = onset_rows.agg(F.count("*").alias("total_events"), F.count_distinct("gpu").alias("distinct_event_gpus"))
    hours = totals.withColumn("_h", F.coalesce(gpus * span / 3600.0, F.lit(0.0)))
    some = F.col("total_events") > 0
    return hours.select(
        "total_events",
        "distinct_event_gpus",
        F.bround("_h", 1).alias("observed_gpu_hours"),
        F.when(some, F.bround(F.col("_h") / F.col("total_events"), 1)).alias("mtbf_gpu_hours_per_event"),
        F.when(F.col("_h") > 0, F.bround(F.col("total_events") / F.col("_h"), 6)).alias("events_per_gpu_hour"),
    )


def by_day(onset_rows: DataFrame, offset: str = TRACE_OFFSET) -> DataFrame:
    """Onsets per calendar day of the trace's own offset."""
    return onset_rows.groupBy(local_day("ts", offset).alias("day")).agg(F.count("*").alias("events")).orderBy("day")


def binned(onset_rows: DataFrame, bin_seconds: int = 300) -> DataFrame:
    """Each onset with its bin number, bins anchored at the first onset."""
    start = onset_rows.agg(F.min(micros("ts"))).scalar()
    return onset_rows.withColumn("bin", bucket_of(micros("ts") - start, bin_seconds * MICROS))


def largest_bin(onset_rows: DataFrame, bin_seconds: int = 300) -> DataFrame:
    """Profile of the fullest bin (earliest on a tie), its share of all onsets and the remainder."""
    rows = binned(onset_rows, bin_seconds)
    # devices and nodes first shrink to one row per bin, then one bin is kept
    profile = rows.groupBy("bin").agg(
        F.count("*").alias("events"),
        F.min("ts").alias("window_start"),
        F.max("ts").alias("window_end"),
    )
    top = profile.orderBy(F.desc("events"), "bin").limit(1)
    inside = rows.join(F.broadcast(top.select("bin")), "bin", "left_semi")  # a single bin number
    spread = inside.agg(F.count_distinct("gpu").alias("distinct_gpus"), F.count_distinct("node").alias("distinct_nodes"))
    total = onset_rows.agg(F.count("*")).scalar()
    return top.select(
        "bin",
        "window_start",
        "window_end",
        "events",
        spread.select("distinct_gpus").scalar().alias("distinct_gpus"),
        spread.select("distinct_nodes").scalar().alias("distinct_nodes"),
        F.bround(F.col("events") / total, 3).alias("frac_of_all_events"),
        (total - F.col("events")).alias("sporadic_events"),
    )


def largest_bin_codes(onset_rows: DataFrame, bin_seconds: int = 300) -> DataFrame:
    """Code mix inside the fullest bin."""
    rows = binned(onset_rows, bin_seconds)
    counts = rows.groupBy("bin", "code").agg(F.count("*").alias("events"))
    top = counts.groupBy("bin").agg(F.sum("events").alias("n")).orderBy(F.desc("n"), "bin").limit(1)
    return counts.where(F.col("bin") == top.select("bin").scalar()).select("code", "events").orderBy(F.desc("events"), "code")


def sample_counts(onset_rows: DataFrame) -> DataFrame:
    return onset_rows.groupBy("ts").agg(F.count("*").alias("n_onsets"))


def timeline(onset_rows: DataFrame, lo: str, hi: str, period_s: int = 15) -> DataFrame:
    """Onsets per sample on the full grid of a closed range, zeros included."""
    spark = onset_rows.sparkSession
    start, end = F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")
    step = F.make_dt_interval(secs=F.lit(period_s))
    grid = spark.range(1).select(F.explode(F.sequence(start, end, step)).alias("ts"))
    inside = sample_counts(onset_rows.where(F.col("ts").between(start, end)))
    return grid.join(inside, "ts", "left").select("ts", F.coalesce("n_onsets", F.lit(0)).alias("n_onsets"))


def scope(onset_rows: DataFrame) -> DataFrame:
    """Distinct devices, nodes and codes of a set of onsets."""
    return onset_rows.agg(
        F.count("*").alias("n_onsets"),
        F.count_distinct("gpu").alias("n_gpus"),
        F.count_distinct("node").alias("n_nodes"),
        F.count_distinct("code").alias("n_codes"),
    )


def gpus_per_node(onset_rows: DataFrame) -> DataFrame:
    """How many nodes had 1, 2, … affected devices."""
    per_node = onset_rows.select("node", "gpu").distinct().groupBy("node").agg(F.count("*").alias("gpus_on_node"))
    return per_node.groupBy("gpus_on_node").agg(F.count("*").alias("n_nodes")).orderBy("gpus_on_node")


def latch_lengths(gauge: DataFrame, affected: DataFrame, start: DataFrame, *, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Latched run and terminal state of each affected device from a burst's first sample on.

    The run counts fault cells from the first one at or after ``start`` (one-cell frame)
    until the device goes idle (NULL), clears to 0 or the trace ends. Work per device is
    split into time chunks; chunk summaries carry the rest.
    """
    t0 = start.scalar()
    later = gauge.where(F.col("ts") >= t0).join(affected.select("gpu").distinct(), "gpu", "left_semi")
    faulted = F.coalesce(F.col("code") != 0, F.lit(False))
    latch = later.where(faulted).groupBy("gpu").agg(F.min(micros("ts")).alias("_f"))
    run = (
        later.select("gpu", micros("ts").alias("_at"), "code", faulted.alias("_on"))
        .join(latch, "gpu")
        .where("_at >= _f")
        .withColumn("_chunk", bucket_of(F.col("_at"), chunk_seconds * MICROS))
    )
    chunk = Window.partitionBy("gpu", "_chunk")
    ended = run.withColumn("_end", F.min(F.when(~F.col("_on"), F.col("_at"))).over(chunk))
    per_chunk = ended.groupBy("gpu", "_chunk").agg(
        F.min("_end").alias("_end"),
        F.count_if(F.col("_end").isNull() | (F.col("_at") < F.col("_end"))).alias("_n"),
        F.max(F.when(F.col("_at") == F.col("_end"), F.col("code").isNull())).alias("_idle"),
    )
    # one row per device and chunk from here on
    first_end = Window.partitionBy("gpu")
    cut = per_chunk.withColumn("_stop", F.min(F.when(F.col("_end").isNotNull(), F.col("_chunk"))).over(first_end))
    kept = cut.where(F.col("_stop").isNull() | (F.col("_chunk") <= F.col("_stop")))
    return kept.groupBy("gpu").agg(
        F.sum("_n").alias("latched_samples"),
        F.when(F.max("_stop").isNull(), F.lit("faulted-to-window-end"))
        .when(F.max(F.when(F.col("_chunk") == F.col("_stop"), F.col("_idle"))), F.lit("went-idle"))
        .otherwise(F.lit("cleared-to-0"))
        .alias("terminal"),
    )


def latch_summary(latches: DataFrame) -> DataFrame:
    """Min, upper median and max run, and how the runs ended."""
    latches = materialize(latches, "latches")  # read by two aggregations
    mid = order_statistics(latches, "latched_samples", {"upper_median": F.floor(F.col("_n") / 2)})
    return latches.agg(
        F.count("*").alias("n_gpus"),
        F.min("latched_samples").alias("min_run"),
        mid.select("upper_median").scalar().alias("upper_median_run"),
        F.max("latched_samples").alias("max_run"),
        F.count_if(F.col("terminal") == "went-idle").alias("went_idle"),
        F.count_if(F.col("terminal") == "cleared-to-0").alias("cleared"),
        F.count_if(F.col("terminal") == "faulted-to-window-end").alias("to_window_end"),
    )


def pre_window_deltas(telemetry: DataFrame, affected: DataFrame, lo, hi) -> DataFrame:
    """Last minus first reading per affected device and metric in a closed range (two samples at least)."""
    inside = telemetry.where(F.col("value").isNotNull() & F.col("ts").between(lo, hi)).join(
        affected.select("gpu").distinct(), "gpu", "left_semi"
    )
    ends = inside.groupBy("gpu", "metric").agg(
        F.count("*").alias("n_samples"), (F.max_by("value", "ts") - F.min_by("value", "ts")).alias("delta")
    )
    return ends.where("n_samples >= 2")


def delta_summary(deltas: DataFrame) -> DataFrame:
    """Per metric: devices, min, upper median, max of the deltas and how many rise."""
    deltas = materialize(deltas.select("metric", "delta"), "deltas")  # read by two aggregations
    mids = order_statistics(deltas, "delta", {"upper_median": F.floor(F.col("_n") / 2)}, keys=["metric"])
    stats = deltas.groupBy("metric").agg(
        F.count("*").alias("n_gpus"),
        F.min("delta").alias("min_delta"),
        F.max("delta").alias("max_delta"),
        F.count_if(F.col("delta") > 0).alias("rising"),
    )
    return stats.join(mids.select("metric", F.col("upper_median").alias("upper_median_delta")), "metric")


def prefault_windows(telemetry: DataFrame, onset_rows: DataFrame, baseline_s: int) -> DataFrame:
    """Readings in ``[t - baseline, t)`` of each onset; overlapping windows each keep their own copy."""
    points = (
        onset_rows.select("gpu", micros("ts").alias("_t"))
        .distinct()
        .withColumn("_lo", F.col("_t") - baseline_s * MICROS)
        .withColumn("_hi", F.col("_t") - 1)
    )
    samples = telemetry.where("value IS NOT NULL").select("gpu", "metric", micros("ts").alias("_at"), "value")
    return range_join(points, samples, keys=["gpu"], lo="_lo", hi="_hi", at="_at", width_us=baseline_s * MICROS).select(
        "gpu", "_t", "metric", "_at", "value"
    )


def precursors(
    telemetry: DataFrame,
    onset_rows: DataFrame,
    *,
    horizons_s: Sequence[int],
    baseline_s: int,
    exclude_s: int,
) -> DataFrame:
    """Per metric and horizon: mean/median shift of the lead window from the baseline, slope, 2-sigma share.

    Baseline is everything before the last ``exclude_s`` seconds (median, sample std, 0 for
    one reading). A lead without baseline or readings does not count. A deviation is
    detectable at two baseline stds, or beyond 1e-9 when the baseline never moves. The
    baselines' medians come from value counts in one global order, so no event's
    readings are held together, however many it has.
    """
    window = materialize(prefault_windows(telemetry, onset_rows, baseline_s), "prefault")  # read for sums and for medians
    before = F.col("_at") < F.col("_t") - exclude_s * MICROS
    base = F.when(before, F.col("value"))
    event = ["gpu", "_t", "metric"]
    medians = exact_medians(window.where(before), "value", keys=event).select(*event, F.col("median").alias("base_med"))
    per_event = window.groupBy(*event).agg(
        F.coalesce(F.stddev_samp(base), F.lit(0.0)).alias("base_std"),
        *[
            x
            for h in horizons_s
            for x in (
                F.avg(F.when(F.col("_at") >= F.col("_t") - h * MICROS, F.col("value"))).alias(f"mean_{h}"),
                F.expr(
                    f"regr_slope(value, (_at - _t) / 60e6D) FILTER (WHERE _at >= _t - {h * MICROS}L)"
                ).alias(f"slope_{h}"),
            )
        ],
    ).join(medians, event)  # an event without baseline does not count
    leads = per_event.select(
        "metric",
        "base_med",
        "base_std",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(h).alias("horizon_s"), F.col(f"mean_{h}").alias("lead"), F.col(f"slope_{h}").alias("slope"))
                    for h in horizons_s
                ]
            )
        ).alias("l"),
    ).select("metric", "base_med", "base_std", "l.*")
    delta = F.col("lead") - F.col("base_med")
    moved = F.abs(delta)
    detectable = ((F.col("base_std") > 0) & (moved >= 2 * F.col("base_std"))) | ((F.col("base_std") == 0) & (moved > 1e-9))
    # one narrow row per event, metric and horizon, so the window join runs once
    usable = materialize(
        leads.where("lead IS NOT NULL AND base_med IS NOT NULL").select(
            "metric", "horizon_s", delta.alias("delta"), "slope", detectable.cast("double").alias("detectable")
        ),
        "leads",
    )
    stats = usable.groupBy("metric", "horizon_s").agg(
        F.count("*").alias("events_with_lead_samples"),
        F.avg("delta").alias("mean_delta"),
        F.avg("slope").alias("mean_slope_per_min"),
        F.avg("detectable").alias("frac_detectable_2sigma"),
    )
    mids = exact_medians(usable, "delta", keys=["metric", "horizon_s"])
    return stats.join(mids.select("metric", "horizon_s", F.col("median").alias("median_delta")), ["metric", "horizon_s"])
