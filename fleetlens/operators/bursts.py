"""Correlated onset bursts and the incident cards, fleet map and series built from them."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.codes import with_code_attributes
from fleetlens.functions.ids import dash_id, ip_sort_key
from fleetlens.operators.telemetry import target_windows
from fleetlens.plans.intervals import MICROS, bucket_of, micros, range_join
from fleetlens.plans.scan import ordered_scan
from fleetlens.session import materialize

BURST_MIN_ONSETS = 40
COHORT_SECONDS = 45
SERIES_SECONDS = 180
META_MINUTES = 20
MAX_CASCADE = 6
MAX_ISOLATED = 4
MAX_LISTED = 8
#: Samples of an island that one task settles (16 MB); a longer one is a storm of a fortnight without a minute's rest.
ISLAND = 1_000_000


def _with_neighbours(rows: DataFrame, reach_us: int) -> tuple[DataFrame, Window]:
    """Rows (column ``_at``) copied to the time buckets they reach, and the bucket's order.

    A range frame of at most ``reach_us`` in the returned window sees every neighbour of
    the rows whose ``_bucket`` equals ``_home``.
    """
    width = max(reach_us, MICROS) * 60
    home = bucket_of(F.col("_at"), width)
    visits = rows.withColumn("_home", home).withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
    into = F.col("_at") - F.col("_home") * width
    near = visits.where(
        (F.col("_bucket") == F.col("_home"))
        | ((F.col("_bucket") < F.col("_home")) & (into <= reach_us))
        | ((F.col("_bucket") > F.col("_home")) & (width - into <= reach_us))
    )
    return near, Window.partitionBy("_bucket").orderBy("_at")


def cohort_sizes(onset_rows: DataFrame, window_s: int = COHORT_SECONDS) -> DataFrame:
    """Onsets within ``±window_s`` (both ends included) of every sample that has one.

    Onsets shrink to one row per sample first; the window runs per time bucket over
    samples only.
    """
    reach = window_s * MICROS
    per_sample = onset_rows.groupBy(micros("ts").alias("_at")).agg(F.count("*").alias("n"))
    near, order = _with_neighbours(per_sample, reach)
    sized = near.withColumn("cohort", F.sum("n").over(order.rangeBetween(-reach, reach))).where("_bucket = _home")
    return sized.select(F.timestamp_micros("_at").alias("ts"), F.col("n").alias("n_onsets"), "cohort")


def cohort_members(onset_rows: DataFrame, centers: DataFrame, window_s: int = COHORT_SECONDS) -> DataFrame:
    """Onsets within ``±window_s`` of each ``center``; an onset near two centres appears twice.

    Centres meet distinct samples first, then the samples' onsets.
    """
    points = centers.select(
        F.lit(0).alias("_k"),
        micros("center").alias("_c"),
        (micros("center") - window_s * MICROS).alias("_lo"),
        (micros("center") + window_s * MICROS).alias("_hi"),
    )
    samples = onset_rows.select(F.lit(0).alias("_k"), micros("ts").alias("_at")).distinct()
    pairs = range_join(points, samples, keys=["_k"], lo="_lo", hi="_hi", at="_at", width_us=2 * window_s * MICROS)
    hit = pairs.select(F.timestamp_micros("_c").alias("center"), F.timestamp_micros("_at").alias("ts"))
    return onset_rows.join(hit, "ts").select("center", *onset_rows.columns)


def burst_centers(
    onset_rows: DataFrame,
    *,
    min_onsets: int = BURST_MIN_ONSETS,
    window_s: int = COHORT_SECONDS,
) -> DataFrame:
    """Burst centres: samples taken by cohort size (then time), each claiming its neighbours.

    A sample is a centre when no stronger centre lies within ``window_s``. No claim
    crosses a gap wider than that, so the timeline falls into islands. Islands of up to
    ISLAND samples are settled one by one in a task each; longer ones in rounds.
    """
    sized = cohort_sizes(onset_rows, window_s).where(F.col("cohort") >= min_onsets)
    state = materialize(sized.select(micros("ts").alias("_at"), "cohort"), "burst")
    reach = window_s * MICROS
    near, order = _with_neighbours(state, reach)
    before = F.count("*").over(order.rangeBetween(-reach, -1))
    starts = near.withColumn("_start", F.when(before == 0, F.col("_at"))).where("_bucket = _home")
    placed = ordered_scan(starts.select("_at", "cohort", "_start"), "_at", {"_island": ("max", "_start")})
    sizes = placed.groupBy("_island").agg(F.count("*").alias("_size"))
    placed = placed.join(sizes, "_island").select("_at", "cohort", "_island", "_size")

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cohort", "descending"), ("_at", "ascending")])
        chosen: list[int] = []
        picked = []
        for row, at in enumerate(table.column("_at").to_pylist()):
            k = bisect_left(chosen, at - reach)
            if k == len(chosen) or chosen[k] > at + reach:
                insort(chosen, at)
                picked.append(row)
        return table.select(["_at", "cohort"]).take(pa.array(picked, pa.int64()))

    short = placed.where(F.col("_size") <= ISLAND).groupBy("_island").applyInArrow(settle, "_at bigint, cohort bigint")
    long = _settled_in_rounds(placed.where(F.col("_size") > ISLAND).select("_at", "cohort"), reach)
    found = short if long is None else short.unionByName(long)
    return found.select(F.timestamp_micros("_at").alias("center"), F.col("cohort").alias("n_onsets"))


def _settled_in_rounds(samples: DataFrame, reach: int) -> DataFrame | None:
    """Centres (``_at``, ``cohort``) of long islands: every round settles the open samples that outrank all open neighbours.

    Each round is a written table; what it chose or closed takes no part in the next
    but as a centre that closes its neighbours. None without samples.
    """
    state = materialize(samples.withColumn("mark", F.lit(0)), "burst")
    if state.isEmpty():
        return None
    while not state.where("mark = 0").isEmpty():  # a round settles at least the strongest open sample
        near, order = _with_neighbours(state, reach)
        frame = order.rangeBetween(-reach, reach)
        # strongest open sample and any centre chosen before, among the neighbours
        power = F.struct(F.col("cohort"), (-F.col("_at")).alias("t"))
        seen = near.select(
            "*",
            F.max(F.when(F.col("mark") == 0, power)).over(frame).alias("_top"),
            F.max(F.when(F.col("mark") == 1, 1)).over(frame).alias("_near"),
        ).where("_bucket = _home")
        open_ = F.col("mark") == 0
        mark = (
            F.when(open_ & F.col("_near").isNotNull(), -1)
            .when(open_ & (F.col("_top.t") == -F.col("_at")), 1)
            .otherwise(F.col("mark"))
        )
        # closed samples neither choose nor block, so only open ones and centres go on
        state = materialize(seen.select("_at", "cohort", mark.alias("mark")).where("mark >= 0"), "burst")
    return state.where("mark = 1").select("_at", "cohort")


def bursts(onset_rows: DataFrame, centers: DataFrame, window_s: int = COHORT_SECONDS) -> DataFrame:
    """Bursts, largest first: centre, onsets, distinct devices and nodes, code counts."""
    members = cohort_members(onset_rows, centers, window_s)
    per_code = members.groupBy("center", "code").agg(F.count("*").alias("n"))
    codes = per_code.groupBy("center").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"),
        F.sum("n").alias("n_onsets"),
    )
    spread = members.groupBy("center").agg(
        F.count_distinct("gpu").alias("n_gpus"), F.count_distinct("node").alias("n_nodes")
    )
    return codes.join(spread, "center").select("center", "n_onsets", "n_gpus", "n_nodes", "codes").orderBy(
        F.desc("n_onsets"), "center"
    )


def hero_center(centers: DataFrame) -> DataFrame:
    """The largest burst's centre, the earliest on a tie (no row without bursts)."""
    return centers.orderBy(F.desc("n_onsets"), "center").limit(1)


def dense_sample_runs(onset_rows: DataFrame, *, threshold: int = BURST_MIN_ONSETS, gap_s: int = 15) -> DataFrame:
    """Runs of dense samples at most ``gap_s`` apart: start, end, samples, onsets, nodes.

    A sample without a dense one in the gap before it starts a run; every sample belongs
    to the latest start at or before it (a running maximum over time).
    """
    gap = gap_s * MICROS
    dense = (
        onset_rows.groupBy(micros("ts").alias("_at")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    )
    near, order = _with_neighbours(dense, gap)
    before = F.count("*").over(order.rangeBetween(-gap, -1))
    starts = near.withColumn("_start", F.when(before == 0, F.col("_at"))).where("_bucket = _home")
    placed = ordered_scan(starts.select("_at", "n", "_start"), "_at", {"_run": ("max", "_start")})
    runs = placed.groupBy("_run").agg(
        F.max("_at").alias("_end"), F.count("*").alias("samples"), F.sum("n").alias("n_onsets")
    )
    nodes = (
        onset_rows.select(micros("ts").alias("_at"), "node")
        .distinct()
        .join(placed.select("_at", "_run"), "_at")
        .groupBy("_run")
        .agg(F.count_distinct("node").alias("n_nodes"))
    )
    return runs.join(nodes, "_run").select(
        F.timestamp_micros("_run").alias("first_ts"),
        F.timestamp_micros("_end").alias("last_ts"),
        "samples",
        "n_onsets",
        "n_nodes",
    )


# --- cards, fleet map and series ----------------------------------------------------------


def incident_cards(
    onset_rows: DataFrame,
    centers: DataFrame,
    window_s: int = COHORT_SECONDS,
) -> DataFrame:
    """The incident feed: hero-burst members by (node, index), then isolated faults.

    A device in any burst is never isolated; isolated faults are the earliest of each code.
    """
    hero = hero_center(centers)
    members = cohort_members(onset_rows, hero.select("center"), window_s)
    cascade = members.orderBy("node", "gpu_idx", "ts", "code").limit(MAX_CASCADE).drop("center")
    in_burst = cohort_members(onset_rows, centers.select("center"), window_s).select("gpu").distinct()
    rest = onset_rows.join(in_burst, "gpu", "left_anti")
    earliest = rest.groupBy("code").agg(
        F.min(F.struct("ts", "gpu", "node", "gpu_idx")).alias("o")
    ).select("o.ts", "o.gpu", "o.node", "o.gpu_idx", "code")
    isolated = earliest.orderBy("ts", "gpu").limit(MAX_ISOLATED)
    picked = cascade.select(
        *onset_rows.columns, F.lit(0).alias("_part")
    ).unionByName(isolated.select(*onset_rows.columns, F.lit(1).alias("_part")))
    # ten rows at most from here on
    order = Window.partitionBy(F.lit(0)).orderBy(
        "_part",
        F.when(F.col("_part") == 0, F.col("node")),
        F.when(F.col("_part") == 0, F.col("gpu_idx")),
        "ts",
        "gpu",
        "code",
    )
    numbered = picked.withColumn("seq", F.row_number().over(order))
    lead_gpu = F.first(F.when(F.col("_part") == 0, F.col("gpu")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    cards = numbered.select(
        F.format_string("INC-%03d", "seq").alias("id"),
        *onset_rows.columns,
        F.coalesce((F.col("_part") == 0) & (F.col("gpu") == lead_gpu), F.lit(False)).alias("hero"),
    )
    return with_cofaults(cards, onset_rows, window_s)


def with_cofaults(cards: DataFrame, onset_rows: DataFrame, window_s: int = COHORT_SECONDS) -> DataFrame:
    """Add code attributes, faults on the same node, cohort size and the listed neighbours.

    ``correlated_count`` includes the card's own onset. The list shows up to eight
    devices, the own one first, then the lowest ids.
    """
    near = cohort_members(onset_rows, cards.select(F.col("ts").alias("center")).distinct(), window_s)
    counts = near.groupBy("center").agg(F.count("*").alias("correlated_count"))
    per_node = near.groupBy("center", "node").agg(F.count("*").alias("_on_node"))
    gpus = near.select("center", "gpu").distinct()
    # the eight lowest ids of a cohort: a rank per centre would hold a whole cohort, a
    # bounded merge of sorted heads does not
    listed = lowest_ids(gpus, "center", "gpu", MAX_LISTED)
    joined = (
        cards.withColumn("center", F.col("ts"))
        .join(counts, "center", "left")
        .join(per_node, ["center", "node"], "left")
        .join(listed, "center", "left")
    )
    head = F.slice(F.col("lowest"), 1, MAX_LISTED)
    names = F.transform(
        F.slice(F.concat(F.array(F.col("gpu")), F.array_remove(head, F.col("gpu"))), 1, MAX_LISTED), lambda g: dash_id(g)
    )
    full = joined.select(
        *cards.columns,
        F.greatest(F.lit(0), F.coalesce("_on_node", F.lit(1)) - 1).alias("node_cofaults"),
        F.coalesce("correlated_count", F.lit(0)).alias("correlated_count"),
        names.alias("correlated"),
    )
    labelled = with_code_attributes(full)
    return labelled.select(
        "id",
        "ts",
        "gpu",
        "node",
        "gpu_idx",
        "code",
        "label",
        "severity",
        "node_cofaults",
        "correlated_count",
        "correlated",
        "hero",
        F.lit("triaging").alias("state"),
    )


def lowest_ids(rows: DataFrame, group: str, value: str, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` lowest distinct values per group, merged from salted heads of ``k`` each."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    part = Window.partitionBy(group, "_salt").orderBy(value)
    heads = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return heads.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(value)), 1, k).alias("lowest"))


def fleet_snapshot(temp_now: DataFrame, util_now: DataFrame, hero_members: DataFrame) -> DataFrame:
    """One cell per device: fault only for hero-burst members, else active or idle by utilisation.

    ``temp_now`` and ``util_now`` are ``(gpu, value)`` at the burst centre.
    """
    temp = temp_now.select("gpu", F.col("value").alias("temp"))
    util = util_now.select("gpu", F.col("value").alias("util"))
    fault = hero_members.groupBy("gpu").agg(F.max_by("code", F.struct("ts", "code")).alias("xid"))
    cells = temp.join(util, "gpu", "full_outer").join(fault, "gpu", "full_outer")
    status = (
        F.when(F.col("xid").isNotNull(), "fault")
        .when(F.col("util").isNull() | (F.col("util") <= 0), "idle")
        .otherwise("active")
    )
    return cells.select(
        F.substring_index("gpu", "#", 1).alias("node"),
        F.substring_index("gpu", "#", -1).cast("int").alias("gpu_idx"),
        F.coalesce("temp", F.lit(0.0)).alias("temp"),
        F.coalesce("util", F.lit(0.0)).alias("util"),
        F.coalesce("xid", F.lit(0)).alias("xid"),
        status.alias("status"),
    )


def overlay_incidents(cells: DataFrame, cards: DataFrame) -> DataFrame:
    """Turn a device's cell to fault when an incident card for it has arrived (the latest code wins)."""
    latest = cards.groupBy("node", "gpu_idx").agg(F.max_by("code", F.struct("ts", "id")).alias("_code"))
    return cells.join(latest, ["node", "gpu_idx"], "left").select(
        "node",
        "gpu_idx",
        "temp",
        "util",
        F.coalesce("_code", "xid").alias("xid"),
        F.when(F.col("_code").isNotNull(), "fault").otherwise(F.col("status")).alias("status"),
    )


def heatmap(cells: DataFrame) -> DataFrame:
    """Cells per node in index order with the fault count, nodes in address order."""
    return (
        cells.groupBy("node")
        .agg(
            F.array_sort(F.collect_list(F.struct("gpu_idx", "temp", "util", "xid", "status"))).alias("cells"),
            F.count_if(F.col("status") == "fault").alias("faults"),
        )
        .orderBy(ip_sort_key("node"))
    )


def board_counts(cards: DataFrame) -> DataFrame:
    """Cards still in triage and distinct nodes hit."""
    return cards.agg(
        F.count_if(F.col("state") == "triaging").alias("triaging"), F.count_distinct("node").alias("nodes_hit")
    )


def incident_series(cards: DataFrame, telemetry: DataFrame, metrics: dict[str, str], window_s: int = SERIES_SECONDS) -> DataFrame:
    """Per card the sorted ``±window_s`` series of each named metric; no readings give an empty array.

    ``metrics`` maps output names to metric names. Keyed by card, so two onsets of one
    device keep their own windows.
    """
    span = F.make_dt_interval(secs=F.lit(window_s))
    targets = cards.select(F.col("id").alias("target_id"), "gpu", (F.col("ts") - span).alias("lo"), (F.col("ts") + span).alias("hi"))
    wanted = telemetry.where(F.col("metric").isin(list(metrics.values())))
    found = target_windows(wanted, targets, width_s=2 * window_s)
    shaped = found.groupBy("target_id").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("metric") == m, F.struct("ts", "value")))).alias(name)
            for name, m in metrics.items()
        ]
    )
    empty = F.array().cast("array<struct<ts: timestamp, value: double>>")
    return (
        cards.join(shaped.withColumnRenamed("target_id", "id"), "id", "left")
        .select(
            "id",
            dash_id("gpu").alias("gpu"),
            F.col("ts").alias("center_ts"),
            F.struct(*[F.coalesce(name, empty).alias(name) for name in metrics]).alias("series"),
        )
    )


def series_of(series: DataFrame, incident_id: str) -> DataFrame:
    """One incident's series; an unknown id is an error that lists the known ones."""
    found = series.where(F.col("id") == incident_id)
    if found.isEmpty():
        known = [r["id"] for r in series.select("id").distinct().orderBy("id").collect()]
        raise KeyError(f"no incident {incident_id!r}; known: {known}")
    return found


def hero_meta(onset_rows: DataFrame, hero: DataFrame, total_gpus: DataFrame, source: str, window_s: int = COHORT_SECONDS, minutes: int = META_MINUTES) -> DataFrame:
    """Board header: event window, burst time, fleet size, burst onsets and nodes (one row, NULLs without a burst)."""
    members = cohort_members(onset_rows, hero.select("center"), window_s)
    span = F.make_dt_interval(mins=F.lit(minutes))
    return members.agg(
        F.max("center").alias("cascade_ts"),
        F.count("*").alias("faulted"),
        F.count_distinct("node").alias("nodes_affected"),
    ).select(
        (F.col("cascade_ts") - span).alias("window_start"),
        (F.col("cascade_ts") + span).alias("window_end"),
        "cascade_ts",
        total_gpus.scalar().alias("total_gpus"),
        "faulted",
        "nodes_affected",
        F.lit(source).alias("source"),
    )


def manifest(
    onset_rows: DataFrame, centers: DataFrame, cards: DataFrame, source: str, period_s: int = 15, window_s: int = COHORT_SECONDS
) -> DataFrame:
    """One row of product facts: totals, hero summary, incident count."""
    hero = bursts(onset_rows, hero_center(centers), window_s).limit(1)
    codes = F.transform_keys("codes", lambda code, n: code.cast("string"))
    spark = onset_rows.sparkSession
    return spark.range(1).select(
        F.lit("fleet-products/v1").alias("schema"),
        F.lit(source).alias("source"),
        F.lit(period_s).alias("sample_period_seconds"),
        onset_rows.agg(F.count("*")).scalar().alias("onset_total"),
        centers.agg(F.count("*")).scalar().alias("burst_count"),
        hero.select(F.struct("center", "n_onsets", "n_gpus", "n_nodes", codes.alias("codes"))).scalar().alias("hero"),
        cards.agg(F.count("*")).scalar().alias("incident_count"),
    )
