from __future__ import annotations

import pytest
from conftest import at

from fleetlens.operators import bursts as ops
from fleetlens.sources import products


def test_products_round_trip_and_are_replaced(spark, onsets_of, tmp_path):
    onset_rows = onsets_of([(15 * (i % 2), f"n{i}#0", 43) for i in range(45)] + [(9000, "z#1", 31)])
    centers = ops.burst_centers(onset_rows)
    hero = ops.hero_center(centers)
    cards = ops.incident_cards(onset_rows, centers)
    readings = spark.createDataFrame([("n0#0", 50.0)], "gpu string, value double")
    tel = spark.createDataFrame([(at(0), "n0#0", "GPU_TEMP", 50.0)], "ts timestamp, gpu string, metric string, value double")
    total = spark.createDataFrame([(100,)], "n bigint")
    made = {
        "incidents": cards,
        "fleet": ops.fleet_snapshot(readings, readings, ops.cohort_members(onset_rows, hero)),
        "meta": ops.hero_meta(onset_rows, hero, total, "trace"),
        "manifest": ops.manifest(onset_rows, centers, cards, "trace"),
        "telemetry": ops.incident_series(cards, tel, {"temp": "GPU_TEMP", "power": "POWER_USAGE", "util": "GPU_UTIL"}),
    }
    root = str(tmp_path / "products")
    assert not products.available(spark, root)
    with pytest.raises(FileNotFoundError):
        products.read_products(spark, root)
    products.write_products(made, root)
    back = products.read_products(spark, root)
    for name, df in made.items():
        assert sorted(map(str, back[name].select(df.columns).collect())) == sorted(map(str, df.collect()))
    meta = back["meta"].first()
    assert (meta.cascade_ts, meta.faulted, meta.nodes_affected, meta.total_gpus) == (at(0), 45, 45, 100)
    assert back["manifest"].first()["hero"]["codes"] == {"43": 45}
    made["incidents"] = cards.limit(1)
    products.write_products(made, root)
    assert products.read_products(spark, root)["incidents"].count() == 1
    with pytest.raises(ValueError, match="missing"):
        products.write_products({"meta": made["meta"]}, root)


def test_no_burst_still_gives_products(spark, onsets_of):
    onset_rows = onsets_of([(0, "n#0", 31), (0, "n#1", 43)])
    centers = ops.burst_centers(onset_rows)
    assert centers.count() == 0
    cards = ops.incident_cards(onset_rows, centers).collect()
    assert [(c.code, c.hero, c.correlated_count) for c in cards] == [(31, False, 2), (43, False, 2)]
    meta = ops.hero_meta(onset_rows, ops.hero_center(centers), spark.createDataFrame([(2,)], "n bigint"), "trace").first()
    assert (meta.cascade_ts, meta.faulted, meta.nodes_affected) == (None, 0, 0)
    assert ops.manifest(onset_rows, centers, ops.incident_cards(onset_rows, centers), "trace").first()["hero"] is None
