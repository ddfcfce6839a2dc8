from __future__ import annotations

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from fleetlens.operators import metrics as ops

ROW = "gpu string, t_ref timestamp, horizon_s double, label int, score double"


def rows_of(spark, n=120, seed=0, levels=15):
    rng = random.Random(seed)
    data = [(f"n#{i % 7}", at(30 * i), 60.0 if i % 2 else 300.0, rng.randrange(2), float(rng.randrange(levels))) for i in range(n)]
    return data, spark.createDataFrame(data, ROW)


def auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def step_ap(pairs):
    total, ap, tp, seen = sum(y for y, _ in pairs), 0.0, 0, 0
    for level in sorted({s for _, s in pairs}, reverse=True):
        here = [y for y, s in pairs if s == level]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) / total * tp / seen
    return ap


@pytest.mark.parametrize("per_bucket", [4, 10_000])
def test_auc_and_ap_with_ties(spark, per_bucket):
    data, df = rows_of(spark)
    got = ops.ranking_metrics(df, rows_per_bucket=per_bucket).first()
    pairs = [(d[3], d[4]) for d in data]
    assert got.roc_auc == pytest.approx(auc(pairs)) and got.avg_precision == pytest.approx(step_ap(pairs))
    for r in ops.ranking_metrics(df, keys=["horizon_s"], rows_per_bucket=per_bucket).collect():
        part = [(d[3], d[4]) for d in data if d[2] == r.horizon_s]
        assert r.roc_auc == pytest.approx(auc(part)) and r.avg_precision == pytest.approx(step_ap(part))


def test_single_class_has_no_metric(spark):
    _, df = rows_of(spark)
    got = ops.ranking_metrics(df.where("label = 1")).first()
    assert got.roc_auc is None and got.avg_precision is None


def test_time_split_sends_ties_to_test(spark):
    points = spark.createDataFrame([("a", at(0)), ("b", at(100)), ("b", at(200)), ("c", at(300)), ("c", at(300)), ("a", at(1000))], "gpu string, t_ref timestamp")
    rows = ops.time_ordered_split(points).collect()
    train, test = [r.t_ref for r in rows if r.is_train], [r.t_ref for r in rows if not r.is_train]
    assert max(train) < min(test) and len(train) == 3 and len(test) == 3
    assert {r.gpu for r in rows if r.is_train} & {r.gpu for r in rows if not r.is_train} == {"a"}


def test_row_split_sizes(spark):
    ten = spark.range(10)
    assert ops.row_order_split(ten, "id", 0.3).where("is_train").count() == 7
    one = spark.range(1)
    assert ops.row_order_split(one, "id", 0.3).where("is_train").count() == 0
    assert ops.row_order_split(one, "id", 0.3, at_least_one=True).where("is_train").count() == 1


@pytest.mark.parametrize("per_bucket", [10, 10_000])
def test_budgets_flag_exactly_k(spark, per_bucket):
    data, df = rows_of(spark, n=200)
    for r in ops.alert_budgets(df, rows_per_bucket=per_bucket).collect():
        assert r.k == max(1, round(r.budget * 200))
        assert r.precision == pytest.approx(r.flagged_positive / r.k)
        assert r.recall == pytest.approx(r.flagged_positive / sum(d[3] for d in data))
    flagged = ops.flag_top(df, 0.05, rows_per_bucket=per_bucket).where("flagged")
    assert flagged.count() == 10
    cut = sorted((d[4] for d in data), reverse=True)[9]
    assert flagged.agg(F.min("score")).first()[0] == cut


def test_leak_probe(spark):
    data, df = rows_of(spark)
    rows = df.withColumn("same", F.col("label").cast("double")).withColumn("noise", F.when(F.col("score") > 3, F.col("score"))).withColumn("void", F.lit(None).cast("double"))
    singles = {r.feature: r.auc for r in ops.single_feature_auc(rows, ["same", "noise", "void"]).collect()}
    assert singles["same"] == 1.0 and "void" not in singles
    assert ops.leakage_probe(ops.single_feature_auc(rows, ["same", "noise"]), 0.5).first()["leaks"]
    assert not ops.leakage_probe(ops.single_feature_auc(rows, ["noise"]), 0.5).first()["leaks"]
    assert ops.leakage_probe(ops.single_feature_auc(rows, ["noise"]), 0.7).first()["leaks"]


def test_holdout_identity_ignores_order_and_sees_labels(spark):
    data, df = rows_of(spark)
    same = spark.createDataFrame(list(reversed(data)), ROW)
    other = spark.createDataFrame([(*data[0][:3], 1 - data[0][3], data[0][4]), *data[1:]], ROW)
    first = ops.holdout_identity(df).first()[0]
    assert ops.holdout_identity(same).first()[0] == first and ops.holdout_identity(other).first()[0] != first


def test_baseline_refuses_one_class(spark):
    _, df = rows_of(spark)
    got = ops.no_skill_baseline(ops.time_ordered_split(df)).first()
    assert got.roc_auc == 0.5 and got.avg_precision == got.base_rate
    with pytest.raises(Exception, match="not scorable"):
        ops.no_skill_baseline(ops.time_ordered_split(df.withColumn("label", F.lit(1)))).collect()


def test_a_leak_through_any_feature_is_seen(spark, monkeypatch):
    """Points whose label shows in a slope only, through the registered queries."""
    from datetime import datetime, timedelta

    import numpy as np

    from fleetlens import schemas
    from fleetlens.operators import models
    from fleetlens.queries import evaluation, views

    rng = np.random.default_rng(0)
    names = [f"{m}_{s}" for m in views.FEATURE_METRICS for s in schemas.WINDOW_STATS]
    label = rng.integers(0, 2, 300)
    values = rng.normal(size=(300, len(names))).round(2)
    values[:, names.index("GPU_UTIL_slope")] = label + 0.1 * values[:, 0]
    start = datetime(2023, 8, 15)
    rows = [(f"n#{i % 3}", "n", i % 3, start + timedelta(hours=i), "e", views.HORIZONS_S[i % 3], 60.0, int(y), *map(float, v)) for i, (y, v) in enumerate(zip(label, values, strict=True))]
    points = spark.createDataFrame(rows, ", ".join(["gpu string, node string, gpu_idx int, t_ref timestamp, event_source string, horizon_s double, lookback_s double, label int", *[f"{n} double" for n in names]])).cache()
    monkeypatch.setattr(views, "points", lambda *_: points)
    fits = []
    monkeypatch.setattr(models, "permuted_auc", lambda early, late, candidate, **kw: fits.append((early.count(), candidate.features)) or 0.75)

    got = {r.feature: r.auc for r in evaluation.full_feature_auc(spark, "").collect()}
    late = np.arange(300) >= 210
    for k, name in enumerate(names):
        pos, neg = values[late & (label == 1), k], values[late & (label == 0), k]
        want = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
        assert abs(got[name] - want) < 1e-8, name
    assert len(got) == len(names) == 40
    ranked = evaluation.full_feature_ranking(spark, "").orderBy("place").collect()
    assert len(ranked) == 40 and ranked[0].feature == "GPU_UTIL_slope"
    assert {r.feature for r in evaluation.full_merged_ranking(spark, "").collect()} == set(names)
    probe = evaluation.full_leakage_probe(spark, "").first()
    assert probe.leaks and probe.max_single_feature_auc == 1.0 and probe.shuffled_label_auc == 0.75
    assert fits == [(210, tuple(names))]
