from __future__ import annotations

import random

from conftest import at
from pyspark.sql import functions as F

from fleetlens.operators import models
from fleetlens.operators.onsets import onsets
from fleetlens.streaming import feeds
from fleetlens.streaming.onsets import OnsetStream


def parts(df, path, n, order):
    """The rows as ``n`` files in time order, one per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        piece = rows[i * size : (i + 1) * size]
        if piece:
            df.sparkSession.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(path)


def test_onsets_over_many_batches_equal_the_batch_answer(spark, gauge_of, tmp_path):
    rng = random.Random(11)
    gauge = gauge_of({f"n#{g}": [rng.choice([None, 0, 43, 43, 31, ...]) for _ in range(40)] for g in range(5)})
    parts(gauge, str(tmp_path / "in"), 6, "ts")
    detector = OnsetStream(str(tmp_path / "run"))
    stream = feeds.table_stream(spark, str(tmp_path / "in"), gauge.schema, files_per_trigger=1)
    detector.start(stream).awaitTermination()
    got = sorted(map(tuple, detector.result(spark).collect()))
    assert got == sorted(map(tuple, onsets(gauge).collect()))
    assert detector.late_counts(spark).count() >= 6


def test_late_rows_are_dropped_and_counted(spark, gauge_of, tmp_path):
    detector = OnsetStream(str(tmp_path / "run"))
    rows = gauge_of({"n#0": [0, 43, 0, 43]})
    detector.process(rows.where(F.col("ts") != at(15)), 0)
    detector.process(rows.where(F.col("ts") == at(15)), 1)
    detector.process(rows.where(F.col("ts") == at(15)), 1)  # a rerun changes nothing
    assert [r.ts for r in detector.result(spark).collect()] == [at(45)]
    assert detector.late_counts(spark).agg(F.sum("late_rows")).first()[0] == 1


def test_feed_delivers_each_id_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("b", at(2))], "id string, ts timestamp")
    parts(rows, str(tmp_path / "in"), 3, "ts")
    stream = feeds.table_stream(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    out = feeds.run_to_table(feeds.badge(feeds.without_duplicates(stream, "ts", "1 minute"), "real"), str(tmp_path / "out"))
    assert sorted((r.id, r.data_source) for r in out.collect()) == [("a", "real"), ("b", "real")]


def test_counts_close_behind_the_watermark(spark, onsets_of, tmp_path):
    rows = onsets_of([(0, "n#0"), (10, "n#1"), (299, "n#2"), (300, "n#3"), (1000, "n#4")])
    rows.write.parquet(str(tmp_path / "in"))
    stream = feeds.table_stream(spark, str(tmp_path / "in"), rows.schema)
    out = feeds.run_to_table(feeds.tumbling_counts(stream, width_s=300), str(tmp_path / "out"))
    assert sorted((r.window_start, r.n_onsets) for r in out.collect()) == [(at(0), 3), (at(300), 1)]


def test_dense_runs_per_cluster(spark, onsets_of, tmp_path):
    rows = onsets_of([(s, f"n#{i}") for s in (0, 15, 60) for i in range(3)] + [(600, "z#0")]).withColumn("cluster", F.lit("c"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = feeds.table_stream(spark, str(tmp_path / "in"), rows.schema)
    out = feeds.run_to_table(feeds.dense_runs(stream, threshold=3), str(tmp_path / "out"))
    assert sorted((r.first_ts, r.samples, r.n_onsets) for r in out.collect()) == [(at(0), 2, 6), (at(60), 1, 3)]


def test_misses_and_catches(spark, tmp_path):
    alerts = spark.createDataFrame([("n#0", at(100), True), ("n#1", at(100), False), ("x#0", at(5000), True)], "gpu string, t_ref timestamp, alert_flag boolean")
    onset = spark.createDataFrame([("n#0", at(130)), ("n#1", at(130)), ("n#0", at(100)), ("x#9", at(5000))], "gpu string, ts timestamp")
    alerts.write.parquet(str(tmp_path / "a"))
    onset.write.parquet(str(tmp_path / "o"))
    a = feeds.table_stream(spark, str(tmp_path / "a"), alerts.schema)
    o = feeds.table_stream(spark, str(tmp_path / "o"), onset.schema)
    out = feeds.run_to_table(feeds.miss_stream(a, o, horizon_s=60, delay="30 seconds"), str(tmp_path / "out"))
    got = {(r.gpu, r.onset_ts): r.caught for r in out.collect()}
    assert got[("n#0", at(130))] is True and got[("n#1", at(130))] is False and got[("n#0", at(100))] is False
    assert ("x#9", at(5000)) not in got  # its window is still open
    called = []
    out.write.parquet(str(tmp_path / "m"))
    feeds.retrain_on_misses(feeds.table_stream(spark, str(tmp_path / "m"), out.schema), lambda: called.append(1), str(tmp_path / "r"), min_misses=2).awaitTermination()
    assert called == [1]


def test_scores_on_arrival_equal_batch_scores(spark, tmp_path):
    rows = spark.createDataFrame([(f"n#{i}", float(i), None if i == 3 else float(-i), int(i > 10)) for i in range(20)], "gpu string, a double, b double, label int")
    model = models.fit(rows, models.Candidate("logreg", ("a", "b")))
    rows.write.parquet(str(tmp_path / "in"))
    out = feeds.run_to_table(feeds.score_stream(feeds.table_stream(spark, str(tmp_path / "in"), rows.schema), model, 0.5, 4), str(tmp_path / "out"))
    want = {r.gpu: r.score for r in models.score(model, rows).collect()}
    assert {r.gpu: r.score for r in out.collect()} == want
    assert all(r.alert_flag == (r.score >= 0.5) and r.model_version == 4 for r in out.collect())
