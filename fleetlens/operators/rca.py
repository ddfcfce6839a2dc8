"""What happened near a failure: other jobs, device faults, telemetry stress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import codes
from fleetlens.functions.timeutil import instant, strict_instant, strict_relative_seconds
from fleetlens.operators.telemetry import window_stats
from fleetlens.plans.intervals import MICROS, exists_within, micros
from fleetlens.plans.scan import ROWS_PER_BUCKET, interval_sums, ordered_scan, row_ranks, tie_key
from fleetlens.session import materialize


def failed_jobs(jobs: DataFrame, states: Sequence[str] = codes.FAIL_STATES) -> DataFrame:
    """Failed jobs with a readable ISO fail time; others are skipped (coincidence analysis)."""
    return (
        jobs.where(F.col("state").isin(list(states)))
        .withColumn("fail_ts", instant("fail_time"))
        .where("fail_ts IS NOT NULL")
    )


def incidents(jobs: DataFrame) -> DataFrame:
    """Failure incidents: blank and ``nan`` times are absent, a malformed one is an error.

    ``fail_ts`` holds ISO times, ``fail_rel`` relative seconds; exactly one is set.
    """
    text = F.trim("fail_time")
    present = text.isNotNull() & (text != "") & (F.lower(text) != "nan")
    return (
        jobs.where(F.col("state").isin(list(codes.FAIL_STATES)) & present)
        .withColumn("fail_ts", strict_instant("fail_time"))
        .withColumn("fail_rel", strict_relative_seconds("fail_time"))
    )


#: Sums of codes and of their squares.
WIDE = "decimal(38,0)"


def jobs_near(incident_rows: DataFrame, center: str | float, window_s: float = 120) -> DataFrame:
    """Other failures within ``±window_s`` of one centre, every incident at that very time left out."""
    if isinstance(center, (int, float)):
        at, c, span = F.col("fail_rel"), F.lit(float(center)), F.lit(float(window_s))
    else:
        at, c = micros("fail_ts"), micros(F.lit(center).cast("timestamp"))
        span = F.lit(int(window_s * MICROS))
    return incident_rows.where((at != c) & (F.abs(at - c) <= span))


def _numbered(rows: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` with a number from 1 on, found by rank, not on the driver."""
    names = rows.select(col).distinct().withColumn("_tie", tie_key(col))
    return row_ranks(names, "_tie", "_tie", out="_code").drop("_tie")


def _single_value(n: str, s1: str, s2: str):
    """The common code of a group known only by count, sum and square sum, else NULL.

    All codes are equal exactly when ``n·Σx² = (Σx)²``.
    """
    total, squares, count = F.col(s1).cast(WIDE), F.col(s2).cast(WIDE), F.col(n).cast(WIDE)
    return F.when((F.col(n) > 0) & (count * squares == total * total), F.floor(total / count).cast("bigint"))


def correlated_failures(incident_rows: DataFrame, window_s: float = 120, *, rows_per_bucket: int | None = ROWS_PER_BUCKET) -> DataFrame:
    """Per distinct failure time: number of other failures near it and their shared type.

    Needs ``fail_ts`` and ``type``; jobs with a relative time only have no place among these
    instants and are left out (see :func:`jobs_near`). Running totals over time, so a time at which a third of
    all jobs fail costs one row. The shared type is set only when all neighbours agree.
    """
    # times are parsed once: from here on one row per distinct time and type
    counted = materialize(
        incident_rows.where("fail_ts IS NOT NULL").groupBy(micros("fail_ts").alias("pos"), F.coalesce("type", F.lit("<null>")).alias("_name")).agg(F.count("*").alias("n")),
        "failures",
    )
    names = _numbered(counted, "_name")
    names = materialize(names, "names")
    code = F.col("_code").cast("decimal(19,0)")
    points = counted.join(names, "_name").select("pos", "n", (code * F.col("n")).cast(WIDE).alias("s1"), (code * code * F.col("n")).cast(WIDE).alias("s2"))
    span = int(window_s * MICROS)
    here = points.groupBy("pos").agg(F.sum("n").alias("n0"), F.sum("s1").alias("s10"), F.sum("s2").alias("s20"))
    probes = here.select((F.col("pos") - span).alias("lo"), (F.col("pos") + span).alias("hi"))
    around = interval_sums(points, probes, ["n", "s1", "s2"], rows_per_bucket=rows_per_bucket)
    net = around.join(here.withColumn("lo", F.col("pos") - span), "lo").select(
        F.timestamp_micros("pos").alias("fail_ts"),
        (F.col("n") - F.col("n0")).alias("n_correlated"),
        (F.col("s1") - F.col("s10")).alias("s1"),
        (F.col("s2") - F.col("s20")).alias("s2"),
    )
    shared = net.withColumn("_code", _single_value("n_correlated", "s1", "s2"))
    return shared.join(names, "_code", "left").select(
        "fail_ts", "n_correlated", F.when(F.col("_name") != "<null>", F.col("_name")).alias("shared_type")
    )


def onsets_near(onset_rows: DataFrame, center: str, window_s: float = 120) -> DataFrame:
    """Onsets within ``±window_s`` of one wall-clock centre."""
    c = micros(F.lit(center).cast("timestamp"))
    return onset_rows.where(F.abs(micros("ts") - c) <= int(window_s * MICROS))


def onset_cohort_summary(onset_rows: DataFrame, center: str, window_s: float = 120) -> DataFrame:
    """One row for one centre: onset count, distinct devices, observed code when there is one only."""
    near = onsets_near(onset_rows, center, window_s)
    return near.agg(
        F.count("*").alias("count"),
        F.count_distinct("gpu").alias("n_gpus"),
        F.when(F.min("code") == F.max("code"), F.min("code")).alias("observed_code"),
    )


def onset_cohorts(failures: DataFrame, onset_rows: DataFrame, window_s: float, *, rows_per_bucket: int | None = ROWS_PER_BUCKET) -> DataFrame:
    """Per distinct ``fail_ts``: onsets within the window and the single code seen, if one."""
    span = int(window_s * MICROS)
    points = onset_rows.select(
        micros("ts").alias("pos"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("code").cast(WIDE).alias("s1"),
        (F.col("code").cast("bigint") * F.col("code")).cast(WIDE).alias("s2"),
    )
    probes = failures.select((micros("fail_ts") - span).alias("lo"), (micros("fail_ts") + span).alias("hi"))
    around = interval_sums(points, probes, ["n", "s1", "s2"], rows_per_bucket=rows_per_bucket)
    return around.select(
        F.timestamp_micros(F.col("lo") + span).alias("fail_ts"),
        F.col("n").alias("n_onsets"),
        _single_value("n", "s1", "s2").alias("observed_code"),
    )


def nearest_onsets(failures: DataFrame, onset_rows: DataFrame, *, rows_per_bucket: int | None = ROWS_PER_BUCKET) -> DataFrame:
    """Per distinct ``fail_ts`` the nearest onset time; the earlier one wins a tie."""
    probe = failures.select(micros("fail_ts").alias("pos")).distinct()
    event = onset_rows.select(micros("ts").alias("pos")).distinct()
    # events sort first at equal instants, so both directions see an onset at the probe itself
    rows = event.select("pos", F.lit(0).alias("kind"), F.col("pos").alias("seen")).unionByName(
        probe.select("pos", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("seen"))
    )
    back = ordered_scan(rows, "pos", {"before": ("max", "seen")}, then=["kind"], rows_per_bucket=rows_per_bucket)
    mirrored = rows.withColumn("neg", -F.col("pos"))
    ahead = ordered_scan(mirrored, "neg", {"after": ("min", "seen")}, then=["kind"], rows_per_bucket=rows_per_bucket)
    both = back.where("kind = 1").select("pos", "before").join(ahead.where("kind = 1").select("pos", "after"), "pos")
    gap_before, gap_after = F.col("pos") - F.col("before"), F.col("after") - F.col("pos")
    nearest = F.when(F.col("after").isNull() | (gap_before <= gap_after), F.col("before")).otherwise(F.col("after"))
    return both.select(F.timestamp_micros("pos").alias("fail_ts"), F.timestamp_micros(nearest).alias("nearest_onset"))


def coincidence(
    jobs: DataFrame, onset_rows: DataFrame, window_minutes: float, span: DataFrame | None = None, *, rows_per_bucket: int | None = ROWS_PER_BUCKET
) -> DataFrame:
    """Each failed job with its onset count within ``±window_minutes`` and nearest onset.

    ``span`` (``first_ts, last_ts``) drops jobs outside the telemetry coverage.
    """
    failed = jobs
    if span is not None:
        failed = failed.where(
            F.col("fail_ts").between(span.select("first_ts").scalar(), span.select("last_ts").scalar())
        )
    near = onset_cohorts(failed, onset_rows, window_minutes * 60, rows_per_bucket=rows_per_bucket).select("fail_ts", "n_onsets")
    closest = nearest_onsets(failed, onset_rows, rows_per_bucket=rows_per_bucket)
    per_time = near.join(closest, "fail_ts", "left")
    # one right row per instant: a busy instant is split by the adaptive skew join
    return failed.join(per_time, "fail_ts", "left").select(
        *[c for c in jobs.columns],
        (F.coalesce("n_onsets", F.lit(0)) > 0).alias("matched"),
        F.coalesce("n_onsets", F.lit(0)).alias("n_onsets"),
        "nearest_onset",
    )


def coincidence_rate(results: DataFrame) -> DataFrame:
    """Matched share of the jobs in the window, 0 when there are none."""
    return results.agg(
        F.count("*").alias("n_jobs"),
        F.count_if("matched").alias("n_matched"),
        F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(0.0)).alias("rate"),
    )


def jobs_near_centers(jobs: DataFrame, centers: DataFrame, window_minutes: float) -> DataFrame:
    """Jobs in state FAILED with a readable time within the window of *any* centre ``ts``."""
    failed = failed_jobs(jobs, ["FAILED"])
    width = int(2 * window_minutes * 60 * MICROS)
    half = width // 2
    probe = failed.withColumn("_one", F.lit(1)).withColumn("_start", micros("fail_ts") - half).withColumn("_span", F.lit(width))
    event = centers.select(F.lit(1).alias("_one"), micros("ts").alias("_at"))
    # the closed window [t-w, t+w] is [t-w, t+w) or an event at exactly t+w
    inside = exists_within(probe, event, keys=["_one"], start="_start", at="_at", spans_us=[width], span="_span", after_start=False, out="_in")
    ends = centers.select((micros("ts") - width).alias("_start")).distinct().withColumn("_end", F.lit(True))
    marked = inside.join(ends, "_start", "left")
    return marked.where(F.col("_in") | F.col("_end").isNotNull()).drop("_one", "_start", "_span", "_in", "_end")


def incident_telemetry(telemetry: DataFrame, centers: DataFrame, window_s: float = 120, metrics: Sequence[str] = ("POWER_USAGE", "GPU_TEMP")) -> DataFrame:
    """Power and temperature stats around each ``fail_ts``, keyed by exporter field, with provenance."""
    span = F.make_dt_interval(secs=F.lit(window_s).cast("decimal(18,6)"))
    spans = centers.select((F.col("fail_ts") - span).alias("lo"), (F.col("fail_ts") + span).alias("hi"))
    stats = window_stats(telemetry, spans, metrics=metrics)
    return stats.select(
        (F.col("lo") + span).alias("fail_ts"),
        codes.metric_field("metric").alias("field"),
        "metric",
        (F.col("samples") > 0).alias("available"),
        "lo",
        "hi",
        "samples",
        "mean",
        "max",
        "min",
    )


def degradation(telemetry: DataFrame, centers: DataFrame, lookback_hours: float = 4, power: str = "POWER_USAGE", temp: str = "GPU_TEMP") -> DataFrame:
    """Stress before each failure: power peak over mean (2 dp), temperature rise (1 dp), flag."""
    back = F.make_dt_interval(secs=F.lit(lookback_hours * 3600).cast("decimal(18,6)"))
    spans = centers.select((F.col("fail_ts") - back).alias("lo"), F.col("fail_ts").alias("hi"))
    stats = window_stats(telemetry, spans, metrics=[power, temp])

    def pick(metric: str, col: str):
        return F.max(F.when(F.col("metric") == metric, F.col(col)))

    wide = stats.groupBy(F.col("hi").alias("fail_ts")).agg(
        pick(power, "max").alias("p_max"),
        pick(power, "mean").alias("p_mean"),
        pick(temp, "max").alias("t_max"),
        pick(temp, "min").alias("t_min"),
        pick(temp, "samples").alias("t_n"),
    )
    spike = F.when(F.col("p_mean") > 0, F.bround(F.col("p_max") / F.col("p_mean"), 2)).otherwise(0.0)
    rise = F.when(F.col("t_n") > 0, F.bround(F.col("t_max") - F.col("t_min"), 1)).otherwise(0.0)
    return wide.select("fail_ts", spike.alias("power_spike_ratio"), rise.alias("temp_rise_C")).withColumn(
        "gradual_degradation_signal", (F.col("power_spike_ratio") > 1.5) | (F.col("temp_rise_C") > 10)
    )
