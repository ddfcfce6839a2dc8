"""Interval joins on time buckets; the exact predicate is always applied again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def bucket_of(us: Column, width_us: int | Column) -> Column:
    """Bucket number of a microsecond instant (floor, also below zero)."""
    width = F.lit(int(width_us)) if isinstance(width_us, (int, float)) else width_us
    return ((us - F.pmod(us, width)) / width).cast("bigint")


def range_join(
    points: DataFrame,
    samples: DataFrame,
    *,
    keys: Sequence[str],
    lo: str,
    hi: str,
    at: str,
    width_us: int,
    how: str = "inner",
) -> DataFrame:
    """Join ``samples`` to every point whose closed ``[lo, hi]`` (microseconds) holds ``at``.

    The key is ``keys`` plus a time bucket, so a key with a third of all samples is spread
    over its buckets. Only the points are repeated (about two buckets each when
    ``width_us`` is near the window length); samples are shuffled once.
    """
    spread = points.withColumn(
        "_bucket",
        F.explode(F.sequence(bucket_of(F.col(lo), width_us), bucket_of(F.col(hi), width_us))),
    )
    placed = samples.withColumn("_bucket", bucket_of(F.col(at), width_us))
    cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys]
    cond += [F.col("p._bucket") == F.col("s._bucket"), F.col(f"s.{at}").between(F.col(f"p.{lo}"), F.col(f"p.{hi}"))]
    joined = spread.alias("p").join(placed.alias("s"), cond, how)
    keep = [F.col(f"p.{c}") for c in points.columns]
    keep += [F.col(f"s.{c}") for c in samples.columns if c not in keys and c not in points.columns]
    return joined.select(*keep)


def exists_within(
    points: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str],
    start: str,
    at: str,
    spans_us: Sequence[int],
    span: str,
    after_start: bool,
    out: str = "hit",
) -> DataFrame:
    """Does an event of the same key fall in a window of ``span`` microseconds from ``start``?

    ``after_start=True`` means ``(start, start+span]``, otherwise ``[start, start+span)``.
    With buckets exactly one span wide the window covers the end of one bucket and the
    beginning of the next, so the latest event of the first and the earliest of the second
    decide it. Events shrink to one row per key and bucket before the join and no pair is
    formed, however many events a bucket holds.
    """
    spans = F.array(*[F.lit(int(s)).cast("bigint") for s in spans_us])
    placed = events.select(*keys, F.col(at).alias("_at"), F.explode(spans).alias("_span")).withColumn(
        "_b", bucket_of(F.col("_at"), F.col("_span"))
    )
    null_at = F.lit(None).cast("bigint")
    ends = (
        placed.select(
            *keys,
            "_span",
            F.explode(
                F.array(
                    F.struct(F.col("_b").alias("b"), F.col("_at").alias("tail"), null_at.alias("head")),
                    F.struct((F.col("_b") - 1).alias("b"), null_at.alias("tail"), F.col("_at").alias("head")),
                )
            ).alias("e"),
        )
        .groupBy(*keys, "_span", F.col("e.b").alias("_b"))
        .agg(F.max("e.tail").alias("_tail"), F.min("e.head").alias("_head"))
    )
    probe = points.withColumn("_span", F.col(span).cast("bigint")).withColumn(
        "_b", bucket_of(F.col(start), F.col("_span"))
    )
    end = F.col(start) + F.col("_span")
    if after_start:
        hit = (F.col("_tail") > F.col(start)) | (F.col("_head") <= end)
    else:
        hit = (F.col("_tail") >= F.col(start)) | (F.col("_head") < end)
    # Catalyst sizes the buckets by the events alone: merged, or every task would hold them all
    joined = probe.join(ends.hint("merge"), [*keys, "_span", "_b"], "left")
    return joined.select(*points.columns, F.coalesce(hit, F.lit(False)).alias(out))


#: Lengths of the time tiles: a second, then four of the one before, up to twelve days.
TILES_US = tuple(4**k * MICROS for k in range(11))
PART = "struct<n:bigint,mean:double,m2:double,low:double,high:double,instants:bigint>"


def moments(value: Column) -> list[Column]:
    """Count, mean and square sum around it, low and high; Spark merges these without cancelling."""
    n = F.count(value)
    return [
        n.alias("n"),
        F.avg(value).alias("mean"),
        (F.coalesce(F.var_pop(value), F.lit(0.0)) * n).alias("m2"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]


def merged(parts: Column) -> Column:
    """The moments of disjoint parts (an array of PART) together, each step around the means themselves."""

    def step(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        both = F.struct(
            n.alias("n"),
            (a["mean"] + d * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"),
            F.least(a["low"], b["low"]).alias("low"),
            F.greatest(a["high"], b["high"]).alias("high"),
            (a["instants"] + b["instants"]).alias("instants"),
        )
        # a part without readings adds its instants only
        return F.when((a["n"] > 0) & (b["n"] > 0), both).when(b["n"] > 0, b.withField("instants", both["instants"])).otherwise(
            a.withField("instants", both["instants"])
        )

    nothing = F.lit(None).cast("double")
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("n"), nothing.alias("mean"), F.lit(0.0).alias("m2"), nothing.alias("low"), nothing.alias("high"), zero.alias("instants")
    )
    return F.aggregate(parts, start.cast(PART), lambda a, b: step(a, b).cast(PART))


def _lookups(spans: DataFrame, first: Column, end: Column) -> DataFrame:
    """``spans`` with ``_level, _tile``: the tiles that make up the seconds ``[first, end)``, coarse ones in the middle, finer ones at both ends."""
    scale = [w // TILES_US[0] for w in TILES_US]
    longer = [b // a for a, b in zip(scale, scale[1:], strict=False)] + [0]  # nothing is coarser than the last level
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).cast("bigint").alias("f"), F.lit(g).cast("bigint").alias("g")) for k, (f, g) in enumerate(zip(scale, longer, strict=True))])
    per_level = spans.withColumns({"_first": first, "_end": end, "_l": F.explode(levels)})

    def whole(length: Column) -> tuple[Column, Column]:
        return -bucket_of(-F.col("_first"), length), bucket_of(F.col("_end"), length)

    (a, b), g = whole(F.col("_l.f")), F.col("_l.g")
    up, down = whole(F.col("_l.f") * F.greatest(g, F.lit(1)))
    placed = per_level.withColumns({"_a": a, "_b": b, "_up": up * g, "_down": down * g}).where("_a < _b")
    # without a whole coarser tile there is none on any level above
    coarser = (g > 0) & (F.col("_up") < F.col("_down"))

    def numbers(lo: Column, hi: Column) -> Column:
        return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))

    left = numbers(F.col("_a"), F.when(coarser, F.col("_up")).otherwise(F.col("_b")))
    right = numbers(F.when(coarser, F.col("_down")).otherwise(F.col("_b")), F.col("_b"))
    return placed.select(*spans.columns, F.col("_l.k").alias("_level"), F.explode(F.concat(left, right)).alias("_tile"))


def interval_moments(
    intervals: DataFrame, samples: DataFrame, *, lo: str, hi: str, at: str, by: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Count, mean, square sum around it, min, max and instants of all samples inside each closed ``[lo, hi]`` (microseconds).

    The interval has no equality key, and a busy stretch may hold any share of the samples,
    so nothing is joined by time. Samples are added up once on fixed tiles of TILES_US, partly
    before any shuffle. An interval is at most six equality lookups per level (and one per
    whole tile of the longest), and only the readings of the seconds its two ends lie in are
    looked at one by one. Lookups are many more rows than the intervals that Catalyst goes
    by, so they are merged, not broadcast. Returns one row per distinct
    interval and ``by`` group that holds an instant; a null value has an instant but no reading.
    """
    by = list(by)
    second = TILES_US[0]
    rows = samples.select(*by, F.col(at).alias("_at"), F.col(value).cast("double").alias("_v"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), bucket_of(F.col("_at"), w).alias("tile")) for k, w in enumerate(TILES_US)]))
    tile = [F.col("_t.level").alias("_level"), F.col("_t.tile").alias("_tile")]
    sums = rows.withColumn("_t", levels).groupBy(*by, *tile).agg(*moments(F.col("_v")))
    instants = rows.select(*by, "_at").distinct().withColumn("_t", levels).groupBy(*by, *tile).agg(F.count("*").alias("instants"))
    keys = [*by, "_level", "_tile"]
    tiles = sums.alias("s").join(instants.alias("i"), _same("s", "i", keys)).select(*[F.col(f"s.{k}") for k in keys], "n", "mean", "m2", "low", "high", "instants")

    # a fixed number of partitions: few bytes of intervals make many lookups
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = intervals.select(F.col(lo).alias("lo"), F.col(hi).alias("hi")).where("lo <= hi").distinct().repartition(parts, "lo", "hi")
    start, end = bucket_of(F.col("lo"), second), bucket_of(F.col("hi"), second)
    inner = start + F.when(F.pmod("lo", F.lit(second)) == 0, 0).otherwise(1)  # the first whole second
    wanted = _lookups(spans, inner, end)
    whole = wanted.hint("merge").join(tiles, ["_level", "_tile"]).select("lo", "hi", *by, "n", "mean", "m2", "low", "high", "instants")

    cut = F.array_distinct(F.array(F.when(inner > start, start).otherwise(end), end))
    edges = spans.select("lo", "hi", F.explode(cut).alias("_s"))
    near = edges.hint("merge").join(rows.withColumn("_s", bucket_of(F.col("_at"), second)), "_s").where(F.col("_at").between(F.col("lo"), F.col("hi")))
    at_ends = near.groupBy("lo", "hi", *by).agg(*moments(F.col("_v")), F.count_distinct("_at").alias("instants"))
    pieces = whole.unionByName(at_ends).groupBy("lo", "hi", *by).agg(F.collect_list(F.struct("n", "mean", "m2", "low", "high", "instants")).alias("_p"))
    return pieces.select("lo", "hi", *by, merged(F.col("_p").cast(f"array<{PART}>")).alias("_m")).select("lo", "hi", *by, "_m.*")


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    found = F.lit(True)
    for k in keys:
        found &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return found
