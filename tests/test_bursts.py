from __future__ import annotations

import random

import pytest
from conftest import at

from fleetlens.operators import bursts as ops


def greedy(samples, min_onsets, window):
    """Samples one by one, strongest first."""
    size = {s: sum(n for t, n in samples.items() if abs(t - s) <= window) for s in samples}
    chosen = []
    for s in sorted(samples, key=lambda x: (-size[x], x)):
        if size[s] >= min_onsets and all(abs(s - c) > window for c in chosen):
            chosen.append(s)
    return sorted((c, size[c]) for c in chosen)


@pytest.mark.parametrize("seed", range(3))
def test_centers_equal_the_one_by_one_choice(onsets_of, seed):
    rng = random.Random(seed)
    rows = [(15 * rng.randrange(400), f"n{i}#0") for i in range(500)]
    counts = {}
    for s, _ in rows:
        counts[s] = counts.get(s, 0) + 1
    got = ops.burst_centers(onsets_of(rows), min_onsets=6, window_s=45).collect()
    assert sorted(((r.center - at(0)).total_seconds(), r.n_onsets) for r in got) == greedy(counts, 6, 45)


@pytest.mark.parametrize("island", [0, 3, 10**6])
def test_islands_and_rounds_choose_alike(onsets_of, monkeypatch, island):
    monkeypatch.setattr(ops, "ISLAND", island)
    rng = random.Random(9)
    rows = [(15 * rng.choice([rng.randrange(40), rng.randrange(400, 900)]), f"n{i}#0") for i in range(400)]
    counts = {}
    for s, _ in rows:
        counts[s] = counts.get(s, 0) + 1
    got = ops.burst_centers(onsets_of(rows), min_onsets=3, window_s=45).collect()
    assert sorted(((r.center - at(0)).total_seconds(), r.n_onsets) for r in got) == greedy(counts, 3, 45)


def test_a_slope_of_a_thousand_samples_takes_few_written_tables(spark, onsets_of, monkeypatch):
    """Each sample is outranked by the next, so rounds would settle one or two at a time."""
    written, write = [], ops.materialize
    monkeypatch.setattr(ops, "materialize", lambda *a: written.append(a[-1]) or write(*a))
    from pyspark.sql import functions as F

    # sample k has k + 1 onsets
    rows = spark.range(1000).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("i"), "id")
    onsets = rows.select(F.timestamp_seconds(F.lit(1_700_000_000) + 15 * F.col("id")).alias("ts"), F.lit("n#0").alias("gpu"), F.lit("n").alias("node"), F.lit(0).alias("gpu_idx"), F.lit(43).alias("code"))
    got = sorted((r.center.timestamp() - 1_700_000_000, r.n_onsets) for r in ops.burst_centers(onsets, min_onsets=40, window_s=45).collect())
    assert got == greedy({15 * k: k + 1 for k in range(1000)}, 40, 45)
    assert len(written) <= 20


def test_adjacent_samples_are_one_burst_and_latched_fleet_is_none(onsets_of):
    rows = [(6000, f"a{i}#{i % 8}") for i in range(30)] + [(6015, f"b{i}#0", 31) for i in range(20)] + [(9000, "z#0", 94)]
    onset_rows = onsets_of(rows)
    centers = ops.burst_centers(onset_rows, min_onsets=40)
    burst = ops.bursts(onset_rows, centers).collect()
    assert len(burst) == 1
    assert (burst[0].center, burst[0].n_onsets, burst[0].n_nodes, burst[0].codes) == (at(6000), 50, 50, {43: 30, 31: 20})
    assert ops.burst_centers(onset_rows, min_onsets=60).count() == 0

    cards = ops.incident_cards(onset_rows, centers).orderBy("id").collect()
    assert [c.id for c in cards] == [f"INC-{i:03d}" for i in range(1, 8)]
    assert cards[0].hero and sum(c.hero for c in cards) == 1
    assert cards[0].correlated_count == 50 and len(cards[0].correlated) == 8 and cards[0].correlated[0] == "a0-0"
    assert (cards[-1].code, cards[-1].correlated_count, cards[-1].node_cofaults, cards[-1].severity) == (94, 1, 0, "warn")


def test_fleet_status_and_overlay(spark, onsets_of):
    temp = spark.createDataFrame([("n#0", 70.0), ("n#1", 40.0)], "gpu string, value double")
    util = spark.createDataFrame([("n#1", 0.0), ("n#2", 55.0)], "gpu string, value double")
    cells = ops.fleet_snapshot(temp, util, onsets_of([(0, "n#0", 31), (15, "m#7", 43)]))
    got = {(c.node, c.gpu_idx): (c.status, c.xid) for c in cells.collect()}
    assert got == {("n", 0): ("fault", 31), ("m", 7): ("fault", 43), ("n", 1): ("idle", 0), ("n", 2): ("active", 0)}
    card = spark.createDataFrame([("INC-009", at(0), "n", 2, 94)], "id string, ts timestamp, node string, gpu_idx int, code int")
    over = {(c.node, c.gpu_idx): (c.status, c.xid) for c in ops.overlay_incidents(cells, card).collect()}
    assert over["n", 2] == ("fault", 94) and over["n", 1] == ("idle", 0)
    assert [r.faults for r in ops.heatmap(cells).orderBy("node").collect()] == [1, 1]


def test_runs_merge_over_one_gap_only(onsets_of):
    rows = [(s, f"n{i}#0") for s in (0, 15, 45, 60) for i in range(3)]
    got = ops.dense_sample_runs(onsets_of(rows), threshold=3, gap_s=15).orderBy("first_ts").collect()
    assert [(r.first_ts, r.samples, r.n_onsets, r.n_nodes) for r in got] == [(at(0), 2, 6, 3), (at(45), 2, 6, 3)]


def test_series_without_readings_is_empty(spark, onsets_of):
    onset_rows = onsets_of([(0, "n#0"), (15, "n#1")])
    centers = ops.burst_centers(onset_rows, min_onsets=2)
    cards = ops.incident_cards(onset_rows, centers)
    tel = spark.createDataFrame([(at(60), "n#0", "GPU_TEMP", 50.0), (at(600), "n#0", "GPU_TEMP", 60.0)], "ts timestamp, gpu string, metric string, value double")
    series = ops.incident_series(cards, tel, {"temp": "GPU_TEMP", "power": "POWER_USAGE"})
    got = {r.gpu: r.series for r in series.collect()}
    assert ops.series_of(series, "INC-002").first()["gpu"] == "n-1"
    with pytest.raises(KeyError, match="INC-001.*INC-002"):
        ops.series_of(series, "INC-404")
    assert [p.value for p in got["n-0"].temp] == [50.0] and got["n-0"].power == [] and got["n-1"].temp == []
