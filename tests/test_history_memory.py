from __future__ import annotations

import pytest
from conftest import at
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.functions.codes import integral_code
from fleetlens.functions.vectors import cosine_to
from fleetlens.operators import incidents, jobs, memory

HISTORY = [(1, 8.0, 100.0, "train", "COMPLETED"), (2, 8.0, 100.0, "train", "COMPLETED"), (3, 16.0, 300.0, "eval", "NODE_FAIL"), (4, 8.0, 90.0, "train", "COMPLETED"), (5, 8.0, 300.0, "eval", "FAILED")]


@pytest.fixture
def history(spark):
    return spark.createDataFrame(HISTORY, "seq bigint, gpu_num double, power_max double, type string, state string")


def test_warm_start_and_replay(history):
    assert sorted(r.seq for r in jobs.warm_start(history, 1, "seq").collect()) == [1, 2, 3]
    assert jobs.warm_start(history, 9, "seq").count() == 5
    assert sorted(r.seq for r in jobs.replay_from(history, 3, "seq").collect()) == [4, 5]
    assert jobs.replay_from(history, 9, "seq").count() == 0


def test_design_matrix(history):
    rows = jobs.design_matrix(history, ["gpu_num", "type"], keep=["seq"]).orderBy("seq").collect()
    assert [(r.type_train, r.type_eval, r.label) for r in rows[1:3]] == [(1, 0, 0), (0, 1, 1)]
    with pytest.raises(KeyError):
        jobs.design_matrix(history, ["nope"])


def test_job_features(spark):
    job = spark.createDataFrame([("j1", at(0), at(300)), ("j2", at(0), at(300)), ("j3", at(90_000), at(90_001))], "job_id string, start_ts timestamp, end_ts timestamp")
    tel = spark.createDataFrame([(at(120), "n#0", "P", 100.0), (at(120), "n#1", "P", 300.0), (at(3600), "n#0", "P", 999.0)], "ts timestamp, gpu string, metric string, value double")
    got = {r.job_id: r for r in jobs.job_features(job, tel, {"power": "P", "temp": "T"}).collect()}
    for j in ("j1", "j2"):
        assert (got[j].power_max, got[j].power_mean, got[j].power_std, got[j].temp_max) == (300.0, 200.0, 100.0, 0.0)
    assert got["j3"].power_mean == 0.0
    assert jobs.sensory(jobs.job_features(job, tel, {"power": "P"}), "j1").columns == ["power_mean", "power_max", "power_std"]


def test_job_features_of_large_values_keep_their_spread(spark):
    job = spark.createDataFrame([("j", at(0), at(100))], "job_id string, start_ts timestamp, end_ts timestamp")
    tel = spark.createDataFrame([(at(t), "n#0", "P", 1e9 + v) for t, v in ((10, 0.0), (20, 0.5), (900, 7.0))], "ts timestamp, gpu string, metric string, value double")
    got = jobs.job_features(job, tel, {"power": "P"}).first()
    assert (got.power_mean, got.power_max, got.power_std) == (1e9 + 0.25, 1e9 + 0.5, pytest.approx(0.25, abs=1e-6))


@pytest.fixture
def sop(spark):
    rows = [
        (1, "train", "Xid 43 hang", "page", "replaced GPU", "INC-1", (2.0, 5.0, 3), [1.0, 0.0]),
        (2, "eval", "thermal", "RESTART", "restart", "INC-2", None, [0.6, 0.8]),
        (3, "eval", "quiet", "restart_and_watch", "none", "INC-1", (None, 1.0, 0), None),
        (4, "eval", "flat", "escalate", "none", "INC-3", None, [0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, schemas.SOP)


def test_similarity_rules(spark, sop):
    got = {r.entry_id: r.s for r in sop.select("entry_id", cosine_to("embedding", [1.0, 0.0]).alias("s")).collect()}
    assert got == {1: 1.0, 2: pytest.approx(0.6), 3: None, 4: 0.0}
    uneven = spark.createDataFrame([([3.0, 4.0, 12.0],), ([],)], "embedding array<float>")
    # extra components count in the norm, not in the dot product; an empty vector scores 0
    assert [r.s for r in uneven.select(cosine_to("embedding", [3.0, 4.0]).alias("s")).collect()] == [pytest.approx(25 / 65), 0.0]
    hits = memory.search_vectors(sop, [1.0, 0.0]).collect()
    assert [(h.entry_id, h.similarity) for h in hits] == [(1, 1.0), (2, 0.6)]


def test_text_fallback_append_and_vectors(spark, sop, tmp_path):
    assert [r.entry_id for r in memory.search_text(sop, "TRAIN").collect()] == [1]
    path = str(tmp_path / "sop")
    memory.append_resolution(path, sop.where("entry_id < 3"))
    memory.append_resolution(path, sop.where("entry_id >= 3"))
    assert spark.read.parquet(path).count() == 4
    vectors = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [2.0]), (2, 1, None)], "entry_id bigint, version int, embedding array<float>")
    assert sorted(r.entry_id for r in memory.missing_vectors(sop, vectors).collect()) == [2, 3, 4]
    assert {r.entry_id: r.embedding for r in memory.with_vectors(sop, vectors).collect()}[1] == [2.0]


def test_feedback_lands_on_the_first_entry(spark, sop):
    marks = spark.createDataFrame([("INC-1", "bad", 1), ("INC-1", "good", 2), ("INC-9", "x", 3)], "incident_id string, outcome string, seq int")
    got = memory.with_outcomes(sop, marks)
    assert {r.entry_id: r.outcome for r in got.collect()} == {1: "good", 2: None, 3: None, 4: None}
    assert got.where("outcome IS NOT NULL").select(memory.feedback_text()).first()[0] == "train Xid 43 hang replaced GPU outcome:good"
    assert [r.incident_id for r in memory.unknown_feedback(sop, marks).collect()] == ["INC-9"]
    rows = {r.entry_id: r for r in jobs.sop_matrix(sop, keep=["entry_id"]).collect()}
    assert {k: (v.power_spike_ratio, v.label) for k, v in rows.items()} == {1: (2.0, 1), 3: (0.0, 0)}


def test_incident_shapes(spark, onsets_of):
    shaped = incidents.from_onsets(onsets_of([(0, "n#0", 31)]))
    row = shaped.first()
    assert row.incident_id == "n#0@2023-08-15 12:00:00.000000" and row.observed.xid == 31.0
    assert incidents.canonical(shaped) is shaped
    cards = spark.createDataFrame([("INC-1", "t0", " 43.0 ", "n", "3", "x"), ("INC-2", "t1", "nan", "m", None, "y")], "id string, ts string, xid string, node string, idx string, extra string")
    got = {r.incident_id: r for r in incidents.canonical(cards).collect()}
    assert (got["INC-1"].gpu, got["INC-1"].observed.xid, got["INC-1"].source, got["INC-1"].details) == ("n-3", 43.0, "xid_onset", {"extra": "x"})
    assert (got["INC-2"].gpu, got["INC-2"].observed.xid, got["INC-2"].source) == ("m", None, "job_trace")
    assert [r[0] for r in spark.createDataFrame([(43.0,), (1.5,)], "c double").select(integral_code("c")).collect()] == ["43", "1.5"]


def test_dispositions(spark):
    texts = ["We ESCALATE now, TKT-0001", "ticket TKT-0002 opened", "please page the technician", "restart it", "paged technician"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(incidents.disposition("t").alias("d"), incidents.ticket_number(F.col("t")).alias("k")).collect()
    assert [r.d for r in rows] == ["ESCALATE_TO_OPS", "PAGE_TECHNICIAN", "PAGE_TECHNICIAN", "RESTART_AND_WATCH", "RESTART_AND_WATCH"]
    assert [r.k for r in rows] == ["TKT-0001", "TKT-0002", None, None, None]
