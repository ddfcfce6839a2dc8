from __future__ import annotations

import random

from conftest import at

from fleetlens.operators import onsets as ops


def state_machine(columns):
    """One device at a time, the plain way."""
    found = []
    for gpu, cells in columns.items():
        state = "unseen"
        for i, cell in enumerate(cells):
            if cell is ...:
                continue
            now = "ok" if cell in (None, 0) else "fault"
            if now == "fault" and state == "ok":
                found.append((gpu, i, int(cell)))
            state = now
    return sorted(found)


def found_in(rows):
    return sorted((r.gpu, int((r.ts - at(0)).total_seconds() // 15), r.code) for r in rows.collect())


def test_onset_matrix(gauge_of):
    columns = {"n#0": [0, 0, 43, 43], "n#1": [43, 43, 0, None], "n#2": [None, 0, 0, 94], "n#3": [0, 43, 0, 43]}
    assert found_in(ops.onsets(gauge_of(columns))) == [("n#0", 2, 43), ("n#2", 3, 94), ("n#3", 1, 43), ("n#3", 3, 43)]
    assert ops.left_censored(gauge_of(columns)).first()[0] == 1


def test_idle_to_fault_counts_only_for_the_empty_aware_detector(gauge_of):
    gauge = gauge_of({"n#0": [None, 43]})
    assert ops.onsets(gauge).count() == 1
    assert ops.strict_onsets(gauge).count() == 0


def test_held_code_and_latched_cascade(gauge_of):
    assert found_in(ops.onsets(gauge_of({"n#0": [0] * 3 + [43] * 47}), chunk_seconds=60)) == [("n#0", 3, 43)]
    fleet = {f"n#{i}": [43] * 20 for i in range(12)} | {"m#0": [0] * 10 + [43] * 10, "m#1": [0] * 14 + [31] * 6}
    assert found_in(ops.onsets(gauge_of(fleet), chunk_seconds=45)) == [("m#0", 10, 43), ("m#1", 14, 31)]


def test_code_change_without_clear_is_no_onset(gauge_of):
    assert found_in(ops.onsets(gauge_of({"n#0": [0, 43, 31, 31]}))) == [("n#0", 1, 43)]


def test_chunking_never_changes_the_answer(gauge_of):
    rng = random.Random(5)
    columns = {f"n#{g}": [rng.choice([None, 0, 0, 43, 31, ...]) for _ in range(120)] for g in range(6)}
    want = state_machine(columns)
    for chunk in (15, 30, 75, 600, 100_000):
        assert found_in(ops.onsets(gauge_of(columns), chunk_seconds=chunk)) == want


def test_spans(gauge_of):
    gauge = gauge_of({"n#0": [None, 0, 43, None]})
    assert ops.sample_span(gauge).first()["span_seconds"] == 45.0
    assert ops.populated_span(gauge).first()["span_seconds"] == 15.0


def test_onsets_from_points_dedupes_horizons(spark):
    rows = [("n#0", at(0), 600.0, 1), ("n#0", at(540), 60.0, 1), ("n#0", at(0), 60.0, 0)]
    points = spark.createDataFrame(rows, "gpu string, t_ref timestamp, horizon_s double, label int")
    assert [(r.gpu, r.ts) for r in ops.onsets_from_points(points).collect()] == [("n#0", at(600))]


def test_cells_of_one_instant_count_the_same_in_any_order(spark):
    cells = [(0, 0.0), (15, 43.0), (15, None), (30, 0.0), (30, 31.0)]
    found = set()
    for seed in range(4):
        rows = [(at(s), "n", 0, "n#0", c) for s, c in random.Random(seed).sample(cells, len(cells))]
        gauge = spark.createDataFrame(rows, "ts timestamp, node string, gpu_idx int, gpu string, code double").repartition(3)
        found.add(tuple(found_in(ops.onsets(gauge))))
    # idle, then fault at 15 s; healthy, then fault at 30 s
    assert found == {(("n#0", 1, 43), ("n#0", 2, 31))}
