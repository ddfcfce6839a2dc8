from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import intervals, scan


@pytest.mark.parametrize("per_bucket", [7, 10_000])
def test_running_totals_match_a_plain_loop(spark, per_bucket):
    rng = random.Random(1)
    rows = [(k, i * 3 + rng.randrange(3), rng.randrange(-5, 9)) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    got = scan.ordered_scan(df, "pos", {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}, keys=["k"], rows_per_bucket=per_bucket)
    want = []
    for k in ("a", "b"):
        seen = []
        for _, pos, v in sorted(r for r in rows if r[0] == k):
            seen.append(v)
            want.append((k, pos, v, sum(seen), max(seen), min(seen)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_value_in_a_third_of_all_rows_is_spread(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("bigint").alias("pos"), scan.tie_key("id").alias("tie"), "id"
    )
    ranked = scan.row_ranks(df, "pos", "tie", rows_per_bucket=100).collect()
    order = sorted(ranked, key=lambda r: (r.pos, r.tie))
    assert [r["rank"] for r in order] == list(range(1, 3001))


def test_many_keys_and_null_ones_and_one_row(spark):
    rows = [(k if k % 50 else None, k * 7 % 13, k % 5 or None) for k in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, pos bigint, v bigint").repartition(3)
    got = scan.ordered_scan(df, "pos", {"s": ("sum", "v"), "hi": ("max", "v")}, keys=["k"], rows_per_bucket=150)
    ends = {r.k: (r.s, r.hi) for r in got.groupBy("k").agg(F.max("s").alias("s"), F.max("hi").alias("hi")).collect()}
    want = {}
    for k, _, v in rows:
        s, hi = want.get(k, (0, None))
        want[k] = (s + (v or 0), max(hi, v) if hi and v else hi or v)
    assert ends == {k: (s, hi) for k, (s, hi) in want.items()}
    one = scan.ordered_scan(df.limit(1), "pos", {"s": ("sum", "pos")}).collect()
    assert [r.s for r in one] == [r.pos for r in one]
    assert scan.ordered_scan(df.limit(0), "pos", {"s": ("sum", "v")}).count() == 0


def test_three_million_rows_a_third_of_them_equal(spark):
    df = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("pos"), F.lit(1).cast("bigint").alias("one"))
    got = scan.ordered_scan(df, "pos", {"rank": ("sum", "one")}, rows_per_bucket=250_000)
    found = got.agg(F.sum("rank"), F.min("rank"), F.max("rank"), F.approx_count_distinct("rank")).first()
    n = 3_000_000
    assert tuple(found)[:3] == (n * (n + 1) // 2, 1, n)
    per_range = got.groupBy(F.floor((F.col("rank") - 1) / 1_000_000)).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("lo").collect()
    assert per_range[0].lo == 1 and all(a.hi <= b.lo for a, b in zip(per_range, per_range[1:], strict=False))


@pytest.mark.parametrize("per_bucket", [5, 10_000])
def test_exact_order_statistics(spark, per_bucket):
    rng = random.Random(2)
    values = {k: [rng.randrange(12) for _ in range(n)] for k, n in (("a", 31), ("b", 40))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    for r in scan.exact_medians(df, "v", keys=["k"], rows_per_bucket=per_bucket).collect():
        assert r["median"] == statistics.median(values[r["k"]]) and r["n"] == len(values[r["k"]])
    one = df.where("k = 'b'")
    q = scan.linear_quantiles(one, "v", {"q90": 0.9}, rows_per_bucket=per_bucket).first()["q90"]
    s = sorted(values["b"])
    at = 0.9 * 39
    assert q == pytest.approx(s[int(at)] + (s[int(at) + 1] - s[int(at)]) * (at - int(at)))


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("per_bucket", [6, 10_000])
def test_interval_sums_against_pairs(spark, closed, per_bucket):
    rng = random.Random(3)
    pts = [(rng.randrange(60), rng.randrange(1, 4)) for _ in range(80)]
    probes = [(a, a + rng.randrange(1, 20)) for a in (rng.randrange(60) for _ in range(25))]
    got = scan.interval_sums(
        spark.createDataFrame(pts, "pos bigint, n bigint"),
        spark.createDataFrame(probes, "lo bigint, hi bigint"),
        ["n"],
        lo_closed=closed,
        hi_closed=closed,
        rows_per_bucket=per_bucket,
    )
    for r in got.collect():
        inside = [n for p, n in pts if (r.lo <= p <= r.hi if closed else r.lo < p < r.hi)]
        assert r.n == sum(inside)


@pytest.mark.parametrize("step", [1, 130_000, 7_000_003, 3_600_000_000, 30_000_000_000])
def test_interval_moments_against_pairs(spark, step):
    """From microseconds to a year, aligned with tiles and not, with values whose squares would cancel."""
    rng = random.Random(4)
    samples = [(rng.choice("xy"), rng.randrange(900) * step, rng.choice([None, 1e9 + rng.randrange(50)])) for _ in range(700)]
    samples += [("x", 400 * step, 1e9)] * 350  # one instant with a third of all readings
    samples += [(None, 5 * step, 2.0)]
    spans = [(a * step, (a + rng.choice([0, 5, 80, 600])) * step + rng.choice([0, 1, -1])) for a in (rng.randrange(-20, 900) for _ in range(40))]
    spans += [(-(10**6), 10**6), (0, 60 * 10**6), (3600 * 10**6, 7200 * 10**6 - 1), (10, 3)]
    got = {
        (r.lo, r.hi, r.m): r
        for r in intervals.interval_moments(
            spark.createDataFrame(spans, "a bigint, b bigint"),
            spark.createDataFrame(samples, "m string, t bigint, value double"),
            lo="a",
            hi="b",
            at="t",
            by=["m"],
        ).collect()
    }
    for lo, hi in set(spans):
        for m in ("x", "y", None):
            cells = [(t, v) for k, t, v in samples if k == m and lo <= t <= hi]
            if not cells:
                assert (lo, hi, m) not in got
                continue
            r, vals = got[lo, hi, m], [v for _, v in cells if v is not None]
            assert (r.n, r.instants) == (len(vals), len({t for t, _ in cells}))
            if vals:
                assert (r.low, r.high) == (min(vals), max(vals))
                mean = math.fsum(vals) / len(vals)
                assert r.mean == pytest.approx(mean, rel=1e-15)
                assert r.m2 == pytest.approx(math.fsum((v - mean) ** 2 for v in vals), rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("after", [True, False])
def test_exists_within_against_pairs(spark, after):
    rng = random.Random(6)
    events = [(rng.choice("ab"), rng.randrange(-50, 400)) for _ in range(40)]
    points = [(rng.choice("ab"), rng.randrange(-50, 400), s) for s in (7, 30) for _ in range(150)]
    got = intervals.exists_within(
        spark.createDataFrame(points, "k string, start bigint, span bigint"),
        spark.createDataFrame(events, "k string, t bigint"),
        keys=["k"],
        start="start",
        at="t",
        spans_us=[7, 30],
        span="span",
        after_start=after,
    ).collect()
    assert len(got) == len(points)
    for r in got:
        inside = any(k == r.k and (r.start < t <= r.start + r.span if after else r.start <= t < r.start + r.span) for k, t in events)
        assert r.hit == inside


def test_range_join_against_pairs(spark):
    rng = random.Random(7)
    points = [(i, rng.choice("ab"), lo, lo + rng.randrange(30)) for i, lo in enumerate(rng.randrange(-40, 200) for _ in range(40))]
    samples = [(rng.choice("ab"), rng.randrange(-40, 230), i) for i in range(150)]
    got = intervals.range_join(
        spark.createDataFrame(points, "id int, k string, lo bigint, hi bigint"),
        spark.createDataFrame(samples, "k string, t bigint, s int"),
        keys=["k"],
        lo="lo",
        hi="hi",
        at="t",
        width_us=20,
    ).collect()
    want = sorted((p[0], s[2]) for p in points for s in samples if p[1] == s[0] and p[2] <= s[1] <= p[3])
    assert sorted((r.id, r.s) for r in got) == want


class _Settings:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Cluster:
    """The parts of a session :func:`shared_dir` reads."""

    master = "spark://somewhere:7077"

    def __init__(self, **values):
        self.conf = _Settings(**values)
        self.sparkContext = self

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_shared_folder_comes_from_the_cluster(spark):
    from fleetlens.session import materialize, shared_dir

    assert shared_dir(_Cluster(**{"spark.checkpoint.dir": "hdfs://shared/ckpt"})) == "hdfs://shared/ckpt"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Cluster())
    assert materialize(spark.range(3).toDF("x")).count() == 3


def test_lookups_of_intervals_are_few_and_not_broadcast(spark):
    """Lookups outnumber the intervals, which are all that Catalyst sees: no list of them may go through the driver."""
    spans = spark.createDataFrame([(i * 7_919_137, i * 7_919_137 + 7_200_000_000) for i in range(200)], "lo bigint, hi bigint")
    start = intervals.bucket_of(F.col("lo"), intervals.MICROS)
    lookups = intervals._lookups(spans, start + 1, intervals.bucket_of(F.col("hi"), intervals.MICROS))
    assert lookups.groupBy("lo").count().agg(F.max("count")).first()[0] <= 6 * 7  # seven levels are shorter than two hours
    samples = spark.createDataFrame([("x", 5_000_000, 1.0)], "m string, t bigint, value double")
    found = intervals.interval_moments(spans, samples, lo="lo", hi="hi", at="t", by=["m"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_level" in plan and "SortMergeJoin [_s" in plan and "BroadcastHashJoin [_level" not in plan and "BroadcastHashJoin [_s" not in plan
