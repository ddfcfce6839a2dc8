from __future__ import annotations

import math

import pytest
from conftest import at

from fleetlens.operators import features as ops

TEL = "ts timestamp, gpu string, metric string, value double"


def test_window_worked_example(spark):
    values = [10.0, 20.0, 30.0, 40.0, 50.0, 999.0]
    tel = spark.createDataFrame([(at(15 * i), "n#0", "T", v) for i, v in enumerate(values)], TEL)
    points = spark.createDataFrame([("n#0", at(60)), ("n#1", at(60))], "gpu string, t_ref timestamp")
    rows = ops.window_features(points, tel, ["T", "P"], lookback_s=45, period_s=15).collect()
    assert len(rows) == 1  # a point without any reading gives no row
    r = rows[0]
    assert (r.T_count, r.T_present, r.T_min, r.T_max, r.T_mean, r.T_last, r.T_delta, r.T_coverage) == (4, 1, 20, 50, 35, 50, 30, 1.0)
    assert r.T_slope == pytest.approx(2 / 3) and r.T_std == pytest.approx(math.sqrt(125))
    assert (r.P_count, r.P_coverage, r.P_present) == (0, 0.0, 0)
    assert all(r[f"P_{s}"] is None for s in ("mean", "std", "min", "max", "last", "delta", "slope"))


def test_one_reading_has_no_slope(spark):
    tel = spark.createDataFrame([(at(0), "n#0", "T", 5.0)], TEL)
    r = ops.window_features(spark.createDataFrame([("n#0", at(15))], "gpu string, t_ref timestamp"), tel, ["T"], lookback_s=45).first()
    assert r.T_slope is None and r.T_std == 0.0 and r.T_delta == 0.0


def _build(spark, onsets_of, **kw):
    a = [40.0, 42.0, 44.0, 46.0, 48.0, 80.0, 95.0, 95.0]
    tel = spark.createDataFrame(
        [(at(15 * i), "n#0", "T", v) for i, v in enumerate(a)] + [(at(15 * i), "n#1", "T", 40.0) for i in range(8)], TEL
    )
    return ops.labelled_points(onsets_of([(90, "n#0")]), tel, metrics=["T"], horizons_s=[30.0], lookback_s=60.0, control_gpus=["n#1"], **kw)


def test_the_spike_never_enters_a_window_that_ends_before_it(spark, onsets_of):
    rows = {(r.gpu, r.label): r for r in _build(spark, onsets_of, neg_offset_s=60.0).collect()}
    pos = rows["n#0", 1]
    assert pos.t_ref == at(60) and pos.T_max == 48.0
    assert rows["n#1", 0].t_ref == at(60) and rows["n#1", 0].T_max == 40.0
    assert rows["n#0", 0].t_ref == at(30)


def test_a_negative_with_an_onset_in_its_horizon_is_dropped(spark, onsets_of):
    rows = _build(spark, onsets_of, neg_offset_s=15.0).collect()
    assert not [r for r in rows if r.gpu == "n#0" and r.label == 0]


def test_positive_wins_over_a_clashing_negative(spark, onsets_of):
    cand = ops.candidates(onsets_of([(100, "n#0"), (130, "n#0")]), horizons_s=[30.0, 60.0], neg_offset_s=60.0)
    rows = {(r.gpu, r.t_ref, r.horizon_s): (r.positive, r.label) for r in cand.collect()}
    assert rows["n#0", at(70), 30.0] == (True, 1)  # also the offset of the second onset
    assert rows["n#0", at(40), 30.0] == (False, 0)
    assert ("n#0", at(70), 60.0) in rows and rows["n#0", at(70), 60.0] == (True, 1)


def test_many_horizons(spark, onsets_of):
    tel = spark.createDataFrame([(at(15 * i), "n#0", "T", float(i)) for i in range(40)], TEL)
    horizons = [float(15 * k) for k in range(1, 36)]
    rows = ops.labelled_points(onsets_of([(570, "n#0")]), tel, metrics=["T"], horizons_s=horizons, lookback_s=60.0, neg_offset_s=9000.0)
    assert {(r.horizon_s, r.T_last) for r in rows.where("label = 1").collect()} == {(h, (570 - h) // 15) for h in horizons}


def test_a_device_with_a_third_of_all_readings_at_any_time(spark):
    hot = [(at(0.25 * i), "n#0", "T", float(i % 97)) for i in range(3000)]
    rest = [(at(15 * i), f"n#{1 + i % 60}", "T", 1.0) for i in range(6000)]
    tel = spark.createDataFrame(hot + rest, TEL).repartition(8)
    points = spark.createDataFrame([("n#0", at(t)) for t in (10, 300, 749)], "gpu string, t_ref timestamp")
    for row in ops.window_features(points, tel, ["T"], lookback_s=120).collect():
        inside = [v for ts, _, _, v in hot if 0 <= (row.t_ref - ts).total_seconds() <= 120]
        assert (row.T_count, row.T_last, row.T_max) == (len(inside), inside[-1], max(inside))
        assert row.T_mean == pytest.approx(sum(inside) / len(inside))


def test_points_and_buckets_are_merged_not_broadcast(spark, onsets_of):
    """Both sides grow with the input, but Catalyst takes exploded ones for small; a broadcast is held whole by every task."""
    faults = onsets_of([(100_000, "a#0"), (200_000, "b#1")])
    points = ops.candidates(faults, horizons_s=[60.0], control_gpus=["c#0"])
    tel = spark.createDataFrame([(at(99_000), "a#0", "GPU_TEMP", 1.0)], TEL)
    for df in (points, ops.window_features(points, tel, ["GPU_TEMP"], lookback_s=600.0)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
