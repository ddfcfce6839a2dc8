from __future__ import annotations

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from fleetlens.operators import rca

NEAR = [
    ("jNEAR", "train", "FAILED", "2023-08-29 05:57:10+00:00"),
    ("jFAR", "train", "FAILED", "2023-08-29 05:10:00+00:00"),
    ("jOK", "train", "COMPLETED", ""),
    ("jMAY", "eval", "FAILED", "2023-05-17 11:00:58+00:00"),
]
JOB = "job_id string, type string, state string, fail_time string"


def test_near_and_far_jobs_against_one_onset(spark):
    jobs = rca.failed_jobs(spark.createDataFrame(NEAR, JOB))
    assert sorted(r.job_id for r in jobs.collect()) == ["jFAR", "jMAY", "jNEAR"]
    onset = spark.sql("SELECT timestamp'2023-08-29 13:57:15+08:00' AS ts, 'n#0' AS gpu, 'n' AS node, 0 AS gpu_idx, 43 AS code")
    span = spark.sql("SELECT timestamp'2023-08-29 13:00:00+08:00' AS first_ts, timestamp'2023-08-29 14:30:00+08:00' AS last_ts")
    got = {r.job_id: r for r in rca.coincidence(jobs, onset, 5, span).collect()}
    assert set(got) == {"jNEAR", "jFAR"}
    assert got["jNEAR"].matched and got["jNEAR"].n_onsets == 1
    assert not got["jFAR"].matched and got["jFAR"].nearest_onset is not None
    assert rca.coincidence_rate(rca.coincidence(jobs, onset, 5, span)).first()["rate"] == 0.5
    none = rca.coincidence_rate(rca.coincidence(jobs.where("false"), onset, 5)).first()
    assert (none["n_jobs"], none["rate"]) == (0, 0.0)


def test_incident_times_fail_loud_but_absent_ones_do_not(spark):
    rows = [("a", "t", "FAILED", "100.5"), ("b", "t", "NODE_FAIL", "2023-08-15 12:00:00+08:00"), ("c", "t", "FAILED", "nan"), ("d", "t", "FAILED", " ")]
    got = {r.job_id: r for r in rca.incidents(spark.createDataFrame(rows, JOB)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].fail_rel == 100.5 and got["a"].fail_ts is None
    assert got["b"].fail_rel is None and got["b"].fail_ts is not None
    with pytest.raises(Exception, match="unparseable"):
        rca.incidents(spark.createDataFrame([("x", "t", "FAILED", "soon")], JOB)).collect()


def test_same_time_is_never_a_neighbour(spark):
    rows = [("a", "train", "NODE_FAIL", "2023-08-15 12:00:00"), ("a2", "train", "NODE_FAIL", "2023-08-15 12:00:00"), ("b", "train", "NODE_FAIL", "2023-08-15 12:01:00")]
    inc = rca.incidents(spark.createDataFrame(rows, JOB))
    assert [r.job_id for r in rca.jobs_near(inc, "2023-08-15 12:00:00", 120).collect()] == ["b"]
    got = {r.fail_ts: (r.n_correlated, r.shared_type) for r in rca.correlated_failures(inc, 120).collect()}
    assert got == {at(0): (1, "train"), at(60): (2, "train")}


def test_relative_traces_compare_in_seconds(spark):
    rows = [("a", "t", "FAILED", "110"), ("b", "t", "FAILED", "100"), ("c", "t", "FAILED", "200")]
    inc = rca.incidents(spark.createDataFrame(rows, JOB))
    assert [r.job_id for r in rca.jobs_near(inc, 110.0, 20).collect()] == ["b"]


@pytest.mark.parametrize("per_bucket", [9, 10_000])
def test_correlated_failures_against_pairs(spark, per_bucket):
    rng = random.Random(8)
    rows = [(f"j{i}", rng.choice(["a", "a", "b", None]), rng.randrange(400)) for i in range(90)]
    inc = spark.createDataFrame([(j, t, at(s)) for j, t, s in rows], "job_id string, type string, fail_ts timestamp")
    for r in rca.correlated_failures(inc, 4, rows_per_bucket=per_bucket).collect():
        c = (r.fail_ts - at(0)).total_seconds()
        near = [t for _, t, s in rows if s != c and abs(s - c) <= 4]
        assert r.n_correlated == len(near)
        assert r.shared_type == (near[0] if len(set(near)) == 1 else None)


@pytest.mark.parametrize("per_bucket", [5, 10_000])
def test_nearest_onset_against_pairs(spark, onsets_of, per_bucket):
    rng = random.Random(9)
    seconds = [rng.randrange(300) for _ in range(25)]
    jobs = spark.createDataFrame([(f"j{i}", at(rng.randrange(-40, 340))) for i in range(60)], "job_id string, fail_ts timestamp")
    for r in rca.nearest_onsets(jobs, onsets_of([(s, "n#0") for s in seconds]), rows_per_bucket=per_bucket).collect():
        c = (r.fail_ts - at(0)).total_seconds()
        assert (r.nearest_onset - at(0)).total_seconds() == min(sorted(seconds), key=lambda s: abs(s - c))


def test_jobs_near_centers_includes_both_ends(spark):
    centers = spark.createDataFrame([(at(1000),), (at(5000),)], "ts timestamp")
    jobs = [(f"j{s}", "t", "FAILED", at(s).strftime("%Y-%m-%d %H:%M:%S")) for s in (399, 400, 1000, 1600, 1601, 4400, 5600)]
    jobs.append(("other", "t", "NODE_FAIL", at(1000).strftime("%Y-%m-%d %H:%M:%S")))
    got = rca.jobs_near_centers(spark.createDataFrame(jobs, JOB), centers, 10)
    assert sorted(r.job_id for r in got.collect()) == ["j1000", "j1600", "j400", "j4400", "j5600"]


def test_window_stats_and_degradation(spark):
    rows = [(at(s), "n", 0, "n#0", m, v) for m, s, v in [("POWER_USAGE", -60, 100.0), ("POWER_USAGE", -30, 300.0), ("POWER_USAGE", -30, None), ("GPU_TEMP", -10, 40.0), ("GPU_TEMP", 0, 55.5), ("GPU_TEMP", 9, 99.0)]]
    tel = spark.createDataFrame(rows, "ts timestamp, node string, gpu_idx int, gpu string, metric string, value double")
    centers = spark.createDataFrame([(at(0),), (at(900_000),)], "fail_ts timestamp")
    got = {r.fail_ts: r for r in rca.degradation(tel, centers).collect()}
    assert (got[at(0)].power_spike_ratio, got[at(0)].temp_rise_C, got[at(0)].gradual_degradation_signal) == (1.5, 15.5, True)
    assert (got[at(900_000)].power_spike_ratio, got[at(900_000)].gradual_degradation_signal) == (0.0, False)
    stats = {r.field: r for r in rca.incident_telemetry(tel, centers.where(F.col("fail_ts") == at(0)), 60).collect()}
    power = stats["DCGM_FI_DEV_POWER_USAGE"]
    assert (power.samples, power["mean"], power["max"], power["min"], power.available) == (2, 200.0, 300.0, 100.0, True)


def test_many_types_are_told_apart_and_relative_times_stay_out(spark):
    rows = [(f"j{i}", f"type {i % 700}", "FAILED", f"2023-08-29 05:{i % 60:02d}:00+00:00") for i in range(1400)] + [("r", "x", "FAILED", "12.5")]
    found = rca.correlated_failures(rca.incidents(spark.createDataFrame(rows, JOB)), 30)
    assert found.count() == 60 and found.where("fail_ts IS NULL OR shared_type IS NOT NULL").isEmpty()
    alike = [(f"j{i}", "same", "FAILED", "2023-08-29 05:00:00+00:00") for i in range(3)]
    near = alike + [("k", "other", "FAILED", "2023-08-29 05:00:20+00:00")]
    got = {r.fail_ts.second: (r.n_correlated, r.shared_type) for r in rca.correlated_failures(rca.incidents(spark.createDataFrame(near, JOB)), 30).collect()}
    assert got == {0: (1, "other"), 20: (3, "same")}
