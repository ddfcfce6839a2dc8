"""Alerting on scored rows and the onsets no alert preceded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.onsets import onsets_from_points
from fleetlens.plans.intervals import MICROS, exists_within, micros, range_join
from fleetlens.plans.scan import linear_quantiles
from fleetlens.schemas import POINT_META

HORIZONS_S = (60.0, 300.0, 600.0)
BUDGETS = (0.01, 0.05, 0.10)
REPORT_ROWS = 500


def thresholds(scored: DataFrame, budgets: Sequence[float] = BUDGETS, *, score: str = "score", **kw) -> DataFrame:
    """Alert threshold per budget: the linear ``1 - budget`` quantile of the scores (+inf without scores)."""
    clamped = [min(max(float(b), 1e-9), 1.0) for b in budgets]
    wide = linear_quantiles(
        scored.select(score), score, {f"q{i}": 1.0 - b for i, b in enumerate(clamped)}, **kw
    )
    rows = wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(float(b)).alias("budget"), F.col(f"q{i}").alias("threshold")) for i, b in enumerate(budgets)])
        ).alias("t")
    ).select("t.*")
    return rows.select("budget", F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"))


def score_flags(scored: DataFrame, threshold_rows: DataFrame, *, score: str = "score") -> DataFrame:
    """Every row once per budget with its ``alert_flag`` (``score >= threshold``; ties may exceed the budget)."""
    levels = threshold_rows.agg(F.collect_list(F.struct("budget", "threshold"))).scalar()  # one entry per budget
    return (
        scored.withColumn("_l", F.explode(levels))
        .withColumn("budget", F.col("_l.budget"))
        .withColumn("alert_flag", F.coalesce(F.col(score) >= F.col("_l.threshold"), F.lit(False)))
        .drop("_l")
    )


def alert_rates(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("budget").agg(
        F.count("*").alias("n_rows"), F.count_if("alert_flag").alias("n_alerts"), F.avg(F.col("alert_flag").cast("double")).alias("alert_rate")
    )


def horizon_grid(flagged: DataFrame, onset_rows: DataFrame, horizons_s: Sequence[float] = HORIZONS_S, budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """Caught and missed onsets per budget and warning horizon.

    An onset is caught when any row of its device in ``[t - H, t)`` was alerted, whatever
    that row's own horizon. Alerts shrink to one row per device and bucket first.
    """
    alerts = flagged.where("alert_flag").select("gpu", "budget", micros("t_ref").alias("_at"))
    onset = onset_rows.select("gpu", micros("ts").alias("_t")).distinct()
    cells = onset.select(
        "gpu",
        "_t",
        F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"),
    ).select("gpu", "_t", "budget", F.explode(F.array(*[F.lit(float(h)) for h in horizons_s])).alias("horizon_s"))
    probes = cells.withColumn("_span", (F.col("horizon_s") * MICROS).cast("bigint")).withColumn("_start", F.col("_t") - F.col("_span"))
    judged = exists_within(
        probes,
        alerts,
        keys=["gpu", "budget"],
        start="_start",
        at="_at",
        spans_us=[int(h * MICROS) for h in horizons_s],
        span="_span",
        after_start=False,
        out="caught",
    )
    return judged.groupBy("budget", "horizon_s").agg(
        F.count("*").alias("n_onsets"),
        F.count_if("caught").alias("caught"),
        F.count_if(~F.col("caught")).alias("missed"),
        F.avg(F.col("caught").cast("double")).alias("recall"),
    )


def prior_scores(flagged: DataFrame, onset_rows: DataFrame, horizon_s: float, *, score: str = "score") -> DataFrame:
    """The scored rows each onset had in ``[t - H, t)``, one row each with its budget's flag."""
    span = int(horizon_s * MICROS)
    probes = (
        onset_rows.select("gpu", "ts", micros("ts").alias("_t"))
        .distinct()
        .select("gpu", "ts", (F.col("_t") - span).alias("_lo"), (F.col("_t") - 1).alias("_hi"))
    )
    rows = flagged.withColumnRenamed("horizon_s", "row_horizon_s").withColumn("_at", micros("t_ref"))
    return range_join(probes.hint("merge"), rows, keys=["gpu"], lo="_lo", hi="_hi", at="_at", width_us=span).drop("_lo", "_hi", "_at")


def detect_misses(
    flagged: DataFrame,
    onset_rows: DataFrame,
    *,
    horizon_s: float,
    model_version: int,
    score: str = "score",
    features: Sequence[str] | None = None,
) -> DataFrame:
    """One event per onset and budget: caught or missed, alerts in the window, last features before it.

    The features come from the latest row before the onset, the largest horizon on a tie.
    Scores of the window are available row by row from :func:`prior_scores`.
    """
    feats = (
        [c for c in flagged.columns if c not in (*POINT_META, score, "budget", "alert_flag", "is_train")] if features is None else list(features)
    )
    # the window join carries no features: it finds which row was last, and only that row
    # is looked up again. One number orders rows by time, then by horizon.
    place = F.col("t_us").cast("decimal(38,0)") * F.lit(10**11).cast("decimal(12,0)") + F.col("h_ms").cast("decimal(38,0)")
    narrow = flagged.select("gpu", "t_ref", "horizon_s", "budget", "alert_flag", score)
    near = prior_scores(narrow, onset_rows, horizon_s, score=score).select(
        "gpu", "ts", "budget", "alert_flag", micros("t_ref").alias("t_us"), (F.col("row_horizon_s") * 1000).cast("bigint").alias("h_ms")
    )
    seen = near.groupBy("gpu", "ts", "budget").agg(
        F.count_if("alert_flag").alias("n_alerts_in_window"),
        F.count("*").alias("n_rows_in_window"),
        F.max(place).alias("_last"),
    )
    rows = flagged.withColumn("t_us", micros("t_ref")).withColumn("h_ms", (F.col("horizon_s") * 1000).cast("bigint")).select(
        "gpu",
        "budget",
        place.alias("_last"),
        F.col(score).alias("last_score"),
        *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(feats)],
    )
    # one of equal rows; the wanted ones are found first, so that only they are compared
    latest = seen.select("gpu", "ts", "budget", "_last").join(rows, ["gpu", "budget", "_last"]).dropDuplicates(["gpu", "ts", "budget"])
    pairs = [x for i, f in enumerate(feats) for x in (F.lit(f), F.col(f"_f{i}"))]
    features_ = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    latest = latest.select("gpu", "ts", "budget", "last_score", features_.alias("pre_event_features"))
    budgets = flagged.select("budget").distinct()
    levels = budgets.agg(F.collect_list("budget")).scalar()  # one entry per budget
    events = onset_rows.select("gpu", "ts").distinct().withColumn("budget", F.explode(levels))
    joined = events.join(seen.drop("_last"), ["gpu", "ts", "budget"], "left").join(latest, ["gpu", "ts", "budget"], "left")
    alerts = F.coalesce("n_alerts_in_window", F.lit(0))
    return joined.select(
        "gpu",
        F.col("ts").alias("onset_ts"),
        F.lit(float(horizon_s)).alias("horizon_s"),
        F.lit(model_version).alias("model_version"),
        "budget",
        (alerts > 0).alias("caught"),
        alerts.alias("n_alerts_in_window"),
        F.coalesce("n_rows_in_window", F.lit(0)).alias("n_rows_in_window"),
        "last_score",
        "pre_event_features",
    )


def report_rows(flagged: DataFrame, budget: float, max_rows: int = REPORT_ROWS) -> DataFrame:
    """The first scored rows in time order at one budget (a bounded report)."""
    return flagged.where(F.col("budget") == budget).orderBy("t_ref", "gpu", "horizon_s").limit(max_rows)


def monitor_report(
    scored: DataFrame,
    *,
    budgets: Sequence[float] = BUDGETS,
    horizons_s: Sequence[float] = HORIZONS_S,
    onset_rows: DataFrame | None = None,
    budget: float | None = None,
    horizon: float | None = None,
    score: str = "score",
) -> DataFrame:
    """Threshold, alert rate and recall per budget and horizon; ``budget``/``horizon`` narrow the grid."""
    budgets = [budget] if budget else list(budgets)
    horizons_s = [horizon] if horizon else list(horizons_s)
    onset_rows = onsets_from_points(scored) if onset_rows is None else onset_rows
    narrow = scored.select("gpu", "t_ref", "horizon_s", score)
    levels = thresholds(narrow, budgets, score=score)
    flagged = score_flags(narrow, levels, score=score)
    grid = horizon_grid(flagged, onset_rows, horizons_s, budgets)
    # a handful of rows on each side: one per budget
    return grid.join(F.broadcast(alert_rates(flagged)), "budget").join(F.broadcast(levels), "budget").select(
        "budget", "horizon_s", "threshold", "alert_rate", "n_onsets", "caught", "missed", "recall"
    )
