"""Running totals over a global order, without putting the order into one task.

A parallel prefix scan: rows are dealt by ranges of the order and sorted where
they lie, every range runs its own window, and what the earlier ranges add up to
is put on top, from a table with one row per range and key. The dealt rows are
written once, so ranges are the same for both. There is one path at every size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import materialize

#: Rows of a range; None leaves the number of ranges to Spark.
ROWS_PER_BUCKET: int | None = None
TIE_BITS = 48  # tie keys are uniform integers in [0, 2**48)

_MERGE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def tie_key(*cols: str | Column) -> Column:
    """A uniform 48-bit integer from the row's identity: a stable, skew-free tie break."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def ordered_scan(
    df: DataFrame,
    pos: str,
    running: Mapping[str, tuple[str, str]],
    *,
    keys: Sequence[str] = (),
    then: Sequence[str] = (),
    tie: str | None = None,
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add inclusive running aggregates over the order ``(pos, then…, tie)`` inside ``keys``.

    ``running`` maps output name to ``(sum|max|min, column)``; nulls are passed over.
    Rows equal in all of the order follow one another in any way. A value that holds
    many rows is cut by ``tie``, and equal rows by a salt, so a range never has to
    hold a whole value. Any number of keys will do, null among them.
    """
    keys = list(keys)
    salt = F.xxhash64(F.monotonically_increasing_id())
    order = [*keys, pos, *then, *([tie] if tie else []), "_scan_salt"]
    salted = df.withColumn("_scan_salt", salt)
    if rows_per_bucket:
        dealt = salted.repartitionByRange(max(1, math.ceil(df.count() / rows_per_bucket)), *order)
    else:
        dealt = salted.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumn("_scan_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_scan_range", F.shiftright("_scan_at", 33)).drop("_scan_salt")  # the high bits number the partition
    inside = Window.partitionBy("_scan_range", *keys).orderBy("_scan_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[_AGG[fn](F.col(c)).over(inside).alias(f"_in_{out}") for out, (fn, c) in running.items()])
    local = materialize(local, "scan")

    totals = local.groupBy("_scan_range", *keys).agg(*[F.max_by(f"_in_{out}", "_scan_at").alias(f"_t_{out}") for out in running])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
        F.col("_scan_range").alias("_scan_of"),
        *[_AGG[fn](F.col(f"_t_{out}")).over(earlier).alias(f"_b_{out}") for out, (fn, _) in running.items()],
    )
    same = F.col("_scan_range") == F.col("_scan_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return local.join(offsets, same).select(
        *df.columns,
        *[_MERGE[fn](F.col(f"_b_{out}"), F.col(f"_in_{out}")).alias(out) for out, (fn, _) in running.items()],
    )


def row_ranks(
    df: DataFrame,
    pos: str,
    tie: str,
    *,
    keys: Sequence[str] = (),
    out: str = "rank",
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based row number over ``(pos, tie)`` inside ``keys``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = ordered_scan(one, pos, {out: ("sum", "_one")}, keys=keys, tie=tie, rows_per_bucket=rows_per_bucket)
    return ranked.drop("_one")


def order_statistics(
    df: DataFrame,
    value: str,
    picks: Mapping[str, Column],
    *,
    keys: Sequence[str] = (),
    weight: str | None = None,
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact sorted-position lookups per key: ``picks`` maps a name to a 0-based index.

    An index expression may use ``_n`` (rows in the group). Equal values are counted
    before the scan, so a heavy value is one row; ``weight`` names a count column when the
    rows are counted already. NULL values are left out.
    """
    keys = list(keys)
    size = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("_c"))
    scanned = ordered_scan(counts, value, {"_upto": ("sum", "_c")}, keys=keys, rows_per_bucket=rows_per_bucket)
    sizes = scanned.groupBy(*[F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)]).agg(F.max("_upto").alias("_n"))
    if keys:
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_s_{i}"))
        sized = scanned.join(sizes, same)
    else:
        sized = scanned.withColumn("_n", sizes.scalar())
    return sized.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.min(F.when(F.col("_upto") > idx, F.col(value))).alias(name) for name, idx in picks.items()],
    )


def exact_medians(df: DataFrame, value: str, *, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Mean of the two middle values, per key."""
    mids = order_statistics(
        df,
        value,
        {"_lo": F.floor((F.col("_n") - 1) / 2), "_hi": F.floor(F.col("_n") / 2)},
        keys=keys,
        **kw,
    )
    return mids.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2.0).alias("median"))


def linear_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], *, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Exact linearly interpolated quantiles; the value list is never held in one place."""
    picks = {}
    for name, q in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        picks[f"_lo_{name}"] = F.floor(at)
        picks[f"_hi_{name}"] = F.ceil(at)
    stats = order_statistics(df, value, picks, keys=keys, **kw)
    cols = []
    for name, q in probs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return stats.select(*keys, "n", *cols)


def interval_sums(
    points: DataFrame,
    probes: DataFrame,
    sums: Sequence[str],
    *,
    pos: str = "pos",
    lo: str = "lo",
    hi: str = "hi",
    lo_closed: bool = True,
    hi_closed: bool = True,
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """For each distinct ``(lo, hi)`` probe, the sums of ``points`` lying between.

    Points are added up per instant and probes are made distinct first; the answer is a
    difference of two running totals, so no point-probe pair is ever formed.
    """
    per_instant = points.groupBy(F.col(pos).cast("bigint").alias("_pos")).agg(*[F.sum(c).alias(c) for c in sums])
    intervals = probes.select(F.col(lo).alias("lo"), F.col(hi).alias("hi")).distinct()
    zero = [F.lit(0).cast(per_instant.schema[c].dataType).alias(c) for c in sums]
    null_long = F.lit(None).cast("bigint")
    events = per_instant.select(
        "_pos", F.lit(1).alias("_kind"), *sums, null_long.alias("lo"), null_long.alias("hi"), F.lit(0).alias("_side")
    )
    ends = intervals.select(
        "lo",
        "hi",
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("p"), F.lit(0 if lo_closed else 2).alias("k"), F.lit(-1).alias("s")),
                F.struct(F.col("hi").alias("p"), F.lit(2 if hi_closed else 0).alias("k"), F.lit(1).alias("s")),
            )
        ).alias("e"),
    ).select(F.col("e.p").alias("_pos"), F.col("e.k").alias("_kind"), *zero, "lo", "hi", F.col("e.s").alias("_side"))
    # ends of equal position: one row per distinct (position, kind) would do, but
    # the sums they carry are zero, so their order among themselves is free
    scanned = ordered_scan(
        events.unionByName(ends),
        "_pos",
        {f"_r_{c}": ("sum", c) for c in sums},
        then=["_kind"],
        rows_per_bucket=rows_per_bucket,
    )
    return (
        scanned.where("_side <> 0")
        .groupBy("lo", "hi")
        .agg(*[F.sum(F.col("_side") * F.col(f"_r_{c}")).alias(c) for c in sums])
    )
