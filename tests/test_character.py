from __future__ import annotations

import random

import pytest
from conftest import at

from fleetlens.operators import character as ops

TEL = "ts timestamp, node string, gpu_idx int, gpu string, metric string, value double"


def test_frequency_guards_zero(onsets_of, spark):
    rows = onsets_of([(0, "n#0"), (3600, "n#1", 31)])
    got = ops.frequency(rows, 10, 7200.0).first()
    assert (got.observed_gpu_hours, got.mtbf_gpu_hours_per_event, got.events_per_gpu_hour) == (20.0, 10.0, 0.1)
    none = ops.frequency(rows.where("false"), 10, 0.0).first()
    assert none.mtbf_gpu_hours_per_event is None and none.events_per_gpu_hour is None
    assert [(r.code, r.code_group) for r in ops.by_code(onsets_of([(0, "n#0", 43), (1, "n#0", 43), (2, "n#0", 7)])).collect()] == [(43, "fatal_hang"), (7, "unknown")]


def test_days_follow_the_trace_offset(onsets_of):
    rows = onsets_of([(0, "n#0"), (5 * 3600, "n#0")])  # 20:00 and 01:00 next day at +08:00
    assert [(r.day, r.events) for r in ops.by_day(rows).collect()] == [("2023-08-15", 1), ("2023-08-16", 1)]


def test_bins_are_anchored_at_the_first_onset(onsets_of):
    rows = onsets_of([(100, "a#0"), (399, "a#1"), (400, "b#0"), (410, "b#1"), (420, "c#0")])
    top = ops.largest_bin(rows, 300).first()
    assert (top.bin, top.events, top.distinct_nodes, top.sporadic_events, top.frac_of_all_events) == (1, 3, 2, 2, 0.6)


def test_timeline_is_zero_filled(onsets_of):
    rows = onsets_of([(15, "n#0"), (15, "n#1")])
    got = ops.timeline(rows, str(at(0)), str(at(45)), 15).orderBy("ts").collect()
    assert [r.n_onsets for r in got] == [0, 2, 0, 0]


@pytest.mark.parametrize("chunk", [15, 45, 3600])
def test_latch_lengths(gauge_of, onsets_of, spark, chunk):
    gauge = gauge_of({"n#0": [0, 43, 43, 43, 0, 43], "n#1": [0, 0, 43, None, 43], "n#2": [0, 43, 43, 43, 43, 43], "n#3": [0, 0, 0, 0, 0, 0]})
    affected = onsets_of([(15, "n#0"), (30, "n#1"), (15, "n#2")])
    start = spark.createDataFrame([(at(15),)], "ts timestamp")
    got = {r.gpu: (r.latched_samples, r.terminal) for r in ops.latch_lengths(gauge, affected, start, chunk_seconds=chunk).collect()}
    assert got == {"n#0": (3, "cleared-to-0"), "n#1": (1, "went-idle"), "n#2": (5, "faulted-to-window-end")}


def test_precursor_rules(spark, onsets_of):
    rows = []
    for i in range(20):  # flat baseline, then a jump in the last minute
        rows.append((at(i * 60), "n", 0, "n#0", "GPU_TEMP", 50.0 if i < 19 else 58.0))
    tel = spark.createDataFrame(rows, TEL)
    got = {r.horizon_s: r for r in ops.precursors(tel, onsets_of([(1200, "n#0")]), horizons_s=[60, 300], baseline_s=7200, exclude_s=600).collect()}
    assert got[60].mean_delta == 8.0 and got[60].frac_detectable_2sigma == 1.0 and got[60].mean_slope_per_min is None
    assert got[300].mean_delta == pytest.approx(1.6) and got[300].mean_slope_per_min == pytest.approx(1.6)
    # nothing before the excluded lead: the event does not count
    late = spark.createDataFrame(rows[-5:], TEL)
    assert ops.precursors(late, onsets_of([(1200, "n#0")]), horizons_s=[60], baseline_s=7200, exclude_s=600).count() == 0


def test_a_baseline_that_holds_a_third_of_all_readings(spark, onsets_of):
    """Medians of very unequal baselines, even and odd, against plain ones."""
    import statistics

    rng = random.Random(3)
    sizes = {"a#0": 3000, "b#1": 2, "c#2": 7, "d#3": 1, "e#4": 40}
    rows = [(at(rng.randrange(5000)), g, "m", float(rng.randrange(30))) for g, n in sizes.items() for _ in range(n)]
    rows += [(at(7000), g, "m", 100.0) for g in sizes]
    tel = spark.createDataFrame(rows, "ts timestamp, gpu string, metric string, value double").repartition(3)
    (got,) = ops.precursors(tel, onsets_of([(7200, g) for g in sizes]), horizons_s=[600], baseline_s=7200, exclude_s=600).collect()
    shifts = [100.0 - statistics.median([v for t, x, _, v in rows if x == g and t < at(6600)]) for g in sizes]
    assert got.events_with_lead_samples == 5
    assert abs(got.mean_delta - statistics.mean(shifts)) < 1e-9 and got.median_delta == statistics.median(shifts)
