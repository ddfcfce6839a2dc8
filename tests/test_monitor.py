from __future__ import annotations

import math
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from fleetlens.operators import incidents, monitor

ROW = "gpu string, t_ref timestamp, horizon_s double, label int, score double, power_max double"


@pytest.fixture
def scored(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        y = rng.random() < 0.4
        data.append((f"n#{i % 7}", at(30 * i), 60.0 if i % 2 else 300.0, int(y), rng.gauss(0.6 if y else 0.4, 0.2), 300.0 + i))
    return spark.createDataFrame(data, ROW)


def test_threshold_is_a_quantile_and_ties_may_exceed(spark):
    even = spark.range(1000).select((F.col("id") / 999.0).alias("score"))
    levels = monitor.thresholds(even)
    for r in monitor.alert_rates(monitor.score_flags(even, levels)).collect():
        assert r.alert_rate == pytest.approx(r.budget, abs=0.002)
    flat = spark.range(50).select(F.lit(0.5).alias("score"))
    assert monitor.alert_rates(monitor.score_flags(flat, monitor.thresholds(flat, [0.05]))).first()["alert_rate"] == 1.0
    assert math.isinf(monitor.thresholds(flat.where("false"), [0.05]).first()["threshold"])


def test_recall_grows_with_the_horizon_and_matches_a_scan(spark, scored):
    onset = spark.createDataFrame([(f"n#{i % 7}", at(500 + 700 * i)) for i in range(15)], "gpu string, ts timestamp")
    flagged = monitor.score_flags(scored, monitor.thresholds(scored))
    grid = {(r.budget, r.horizon_s): r for r in monitor.horizon_grid(flagged, onset).collect()}
    rows, events = flagged.collect(), onset.collect()
    for (b, h), r in grid.items():
        caught = sum(
            any(x.gpu == e.gpu and x.budget == b and x.alert_flag and 0 < (e.ts - x.t_ref).total_seconds() <= h for x in rows) for e in events
        )
        assert (r.caught, r.n_onsets) == (caught, 15)
    for b in monitor.BUDGETS:
        assert grid[b, 60.0].recall <= grid[b, 300.0].recall <= grid[b, 600.0].recall


def test_miss_carries_latest_features_of_the_largest_horizon(spark):
    data = [("n#0", at(0), 60.0, 0, 0.9, 1.0), ("n#0", at(90), 60.0, 0, 0.1, 2.0), ("n#0", at(90), 300.0, 0, 0.2, 3.0), ("n#0", at(100), 60.0, 1, 0.95, 4.0)]
    flagged = spark.createDataFrame(data, ROW).withColumn("budget", F.lit(0.05)).withColumn("alert_flag", F.col("score") > 0.5)
    onset = spark.createDataFrame([("n#0", at(100)), ("n#9", at(100))], "gpu string, ts timestamp")
    got = {r.gpu: r for r in monitor.detect_misses(flagged, onset, horizon_s=60, model_version=3).collect()}
    hit, other = got["n#0"], got["n#9"]
    # the row at the onset itself is not before it; the alert at 0 s is outside the window
    assert (hit.caught, hit.n_alerts_in_window, hit.n_rows_in_window, hit.pre_event_features) == (False, 0, 2, {"power_max": 3.0})
    assert (other.caught, other.pre_event_features) == (False, None)
    wide = monitor.detect_misses(flagged, onset.where("gpu = 'n#0'"), horizon_s=100, model_version=3).first()
    assert wide.caught and wide.n_alerts_in_window == 1
    assert monitor.prior_scores(flagged, onset, 60).count() == 2
    shaped = incidents.from_misses(monitor.detect_misses(flagged, onset, horizon_s=60, model_version=3)).where("gpu = 'n#0'").first()
    assert shaped.observed.xid is None and shaped.detection.missed and shaped.details == {"power_max": "3.0"}


def test_report_narrows_to_one_cell(scored):
    assert monitor.monitor_report(scored).count() == 9
    one = monitor.monitor_report(scored, budget=0.05, horizon=300.0).collect()
    assert [(r.budget, r.horizon_s) for r in one] == [(0.05, 300.0)]
    rows = monitor.report_rows(monitor.score_flags(scored, monitor.thresholds(scored)), 0.01, 5).collect()
    assert [r.t_ref for r in rows] == [at(30 * i) for i in range(5)]
