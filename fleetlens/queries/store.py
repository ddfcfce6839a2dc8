"""Queries over the long telemetry table and the wide-text reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import ids
from fleetlens.functions.timeutil import iso
from fleetlens.operators import telemetry as ops
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, with_views
from fleetlens.session import scratch_path
from fleetlens.sources import tables
from fleetlens.sources.wide_source import register

WINDOW_S = 7200


def _peak(spark, sf_dir):
    """Device, metric and time of the largest reading: the subject of the point lookups."""
    tel = views.telemetry(spark, sf_dir)
    best = tel.agg(F.max(F.struct("value", "ts", "gpu", "metric")).alias("b"))
    # the time leaves Spark as text of the session's zone, whatever the driver's own zone is
    row = best.select("b.gpu", "b.metric", F.date_format("b.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).first()
    return tel, row["gpu"], row["metric"], row["ts"]


_PEAK = "pk AS (SELECT gpu, metric, ts, us FROM tel ORDER BY value DESC, ts DESC, gpu DESC, metric DESC LIMIT 1)"


@query(
    "wide_text",
    with_views(
        """WITH w AS (SELECT ts, gpu_idx, value, k, CASE WHEN k % 2 = 1 THEN gpu_idx + 1 ELSE 8 END AS width FROM ev),
        c AS (SELECT i, w.*, CASE WHEN w.gpu_idx = i THEN value END AS cell FROM w, (SELECT unnest(range(8)) AS i) WHERE i < w.width)
        SELECT 'slot#' || i AS gpu, count(*) AS cells, count(cell) AS readings, count(*) - count(cell) AS idle, round(sum(cell), 4) AS total FROM c GROUP BY i""",
        "ev",
    ),
)
def wide_text(spark, sf_dir):
    """Events written as wide text files (empty and missing cells, ISO and relative times) and read back as long rows."""
    long = _wide_rows(spark, sf_dir)
    return long.groupBy("gpu").agg(
        F.count("*").alias("cells"),
        F.count("value").alias("readings"),
        F.count_if(F.col("value").isNull()).alias("idle"),
        F.round(F.sum("value"), 4).alias("total"),
    )


#: What relative times count from.
_ORIGIN = "2024-01-01 00:00:00+00:00"


def _wide_rows(spark, sf_dir):
    """All cells of the events' wide files, through the data source; every file has its own header line."""
    ev = views.fleet_events(spark, sf_dir)
    header = ",".join(["Time", *[f"slot-{i}" for i in range(8)]])
    width = F.when(F.col("k") % 2 == 1, F.col("gpu_idx") + 1).otherwise(8)
    text = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i == F.col("gpu_idx"), F.col("value").cast("string")).otherwise(F.lit("")))
    cells = F.array_join(text, ",")
    seconds = ((F.unix_micros("ts") - F.unix_micros(F.to_timestamp(F.lit(_ORIGIN)))).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(24,6)")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    path = scratch_path(spark, "wide")
    register(spark)
    read = spark.read.format("widecsv").option("origin", _ORIGIN)
    out = None
    for kind, rows, time in (
        ("iso", ev.where("k % 3 <> 0"), F.concat(iso("ts"), F.lit("+00:00"))),
        ("relative", ev.where("k % 3 = 0"), seconds.cast("string")),
    ):
        lines = rows.repartition(4, "k").select(F.concat_ws(",", time, cells).alias("line"))
        # the first line of a file comes after its header
        lines.select(F.when(first, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line")).alias("value")).write.text(f"{path}/{kind}")
        part = read.load(f"{path}/{kind}")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "wide_source",
    with_views(
        f"""WITH w AS (SELECT ts, gpu_idx, value, k, CASE WHEN k % 2 = 1 THEN gpu_idx + 1 ELSE 8 END AS width FROM ev),
        c AS (SELECT i, w.*, CASE WHEN w.gpu_idx = i THEN value END AS cell FROM w, (SELECT unnest(range(8)) AS i) WHERE i < w.width)
        SELECT 'slot#' || i AS gpu, count(*) AS readings, round(sum(cell), 4) AS total, strftime(min(ts), {ISO}) AS first, strftime(max(ts), {ISO}) AS last
        FROM c WHERE i IN (1, 4, 6) AND cell IS NOT NULL AND ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-22 12:30:00' GROUP BY i""",
        "ev",
    ),
)
def wide_source(spark, sf_dir):
    """Readings of three devices in a fortnight; devices, times and idle cells are settled in the scan of the wide files."""
    inside = (F.col("ts") >= F.to_timestamp(F.lit("2024-01-08 00:00:00"))) & (F.col("ts") < F.to_timestamp(F.lit("2024-01-22 12:30:00")))
    some = _wide_rows(spark, sf_dir).where(inside & F.col("gpu").isin("slot#1", "slot#4", "slot#6") & F.col("value").isNotNull())
    return some.groupBy("gpu").agg(
        F.count("*").alias("readings"), F.round(F.sum("value"), 4).alias("total"), iso(F.min("ts")).alias("first"), iso(F.max("ts")).alias("last")
    )


@query("point_value", with_views(f"WITH {_PEAK} SELECT t.value FROM tel t JOIN pk USING (gpu, metric, ts)", "tel"))
def point_value(spark, sf_dir):
    tel, gpu, metric, ts = _peak(spark, sf_dir)
    return ops.value_at(tel, metric, gpu, ts)


@query(
    "snapshot",
    with_views(f"WITH {_PEAK} SELECT t.gpu, t.metric, t.value FROM tel t JOIN pk ON t.gpu = pk.gpu AND t.ts = pk.ts", "tel"),
)
def snapshot(spark, sf_dir):
    tel, gpu, _, ts = _peak(spark, sf_dir)
    snap = ops.snapshot(tel, gpu, ts)
    return snap.select("gpu", F.explode("readings").alias("metric", "value"))


@query("series", with_views(f"WITH {_PEAK} SELECT strftime(t.ts, {ISO}) AS ts, t.value FROM tel t JOIN pk USING (gpu, metric)", "tel"))
def series(spark, sf_dir):
    tel, gpu, metric, _ = _peak(spark, sf_dir)
    return ops.series(tel, metric, gpu).select(iso("ts").alias("ts"), "value")


@query("device_timestamps", with_views(f"WITH {_PEAK} SELECT DISTINCT strftime(t.ts, {ISO}) AS ts FROM tel t JOIN pk USING (gpu)", "tel"))
def device_timestamps(spark, sf_dir):
    tel, gpu, _, _ = _peak(spark, sf_dir)
    return ops.timestamps(tel, gpu).select(iso("ts").alias("ts"))


_WIDE = ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in views.FEATURE_METRICS)
_IN = ", ".join(repr(m) for m in views.FEATURE_METRICS)


@query(
    "wide_window",
    with_views(
        f"SELECT gpu, strftime(ts, {ISO}) AS ts, {_WIDE} FROM tel WHERE metric IN ({_IN}) AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY gpu, ts",
        "tel",
    ),
)
def wide_window(spark, sf_dir):
    wide = ops.wide_window(views.telemetry(spark, sf_dir), views.FEATURE_METRICS, lo="2024-01-05 00:00:00", hi="2024-01-20 00:00:00")
    return wide.withColumn("ts", iso("ts"))


@query("observed_gpus", with_views("SELECT DISTINCT gpu FROM tel WHERE value IS NOT NULL", "tel"))
def observed_gpus(spark, sf_dir):
    return ops.observed_gpus(views.telemetry(spark, sf_dir))


@query(
    "requested_metrics",
    with_views(
        """SELECT m.metric, count(t.value) AS n_rows FROM (SELECT unnest(['GPU_TEMP', 'POWER_USAGE', 'SM_ACTIVE']) AS metric) m
        LEFT JOIN tel t ON t.metric = m.metric GROUP BY m.metric""",
        "tel",
    ),
)
def requested_metrics(spark, sf_dir):
    return ops.requested_metrics(views.telemetry(spark, sf_dir), ["GPU_TEMP", "POWER_USAGE", "SM_ACTIVE"])


@query(
    "fleet_reading",
    with_views(
        "SELECT gpu, value FROM gtel WHERE metric = 'GPU_TEMP' AND us = epoch_us(TIMESTAMP '2024-01-10 12:00:00') AND value IS NOT NULL", "gtel"
    ),
)
def fleet_reading(spark, sf_dir):
    """Every device's hourly temperature reading at one instant."""
    return ops.fleet_reading(views.grid_telemetry(spark, sf_dir), "GPU_TEMP", "2024-01-10 12:00:00").select("gpu", "value")


@query(
    "target_windows",
    with_views(
        f"""SELECT o.gpu, strftime(o.ts, {ISO}) AS onset, t.metric, strftime(t.ts, {ISO}) AS ts, t.value FROM (SELECT DISTINCT gpu, ts, us FROM ons) o JOIN tel t
        ON t.gpu = o.gpu AND t.us BETWEEN o.us - 10800000000 AND o.us + 10800000000""",
        "ons",
        "tel",
    ),
)
def target_windows(spark, sf_dir):
    """Hourly readings of the faulting device within three hours of each onset."""
    span = F.expr("INTERVAL 3 HOURS")
    targets = (
        views.onsets(spark, sf_dir)
        .select("gpu", "ts")
        .distinct()
        .select(F.struct("gpu", "ts").alias("target_id"), "gpu", (F.col("ts") - span).alias("lo"), (F.col("ts") + span).alias("hi"))
    )
    found = ops.target_windows(views.telemetry(spark, sf_dir), targets, width_s=21600)
    return found.select("gpu", iso("target_id.ts").alias("onset"), "metric", iso("ts").alias("ts"), "value")


@query(
    "resample",
    with_views(f"SELECT gpu, metric, strftime(ts, {ISO}) AS ts, value FROM gtel", "gtel"),
)
def resample(spark, sf_dir):
    """The last reading per device, metric and hour."""
    return views.grid_telemetry(spark, sf_dir).select("gpu", "metric", iso("ts").alias("ts"), "value")


@query(
    "downsample",
    with_views(
        f"""WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY metric ORDER BY ts) AS rk FROM tel WHERE value IS NOT NULL)
        SELECT metric, gpu, strftime(ts, {ISO}) AS ts, value FROM r WHERE (rk - 1) % 7 = 0""",
        "tel",
    ),
)
def downsample(spark, sf_dir):
    kept = ops.downsample_timestamps(views.telemetry(spark, sf_dir), 7)
    return kept.select("metric", "gpu", iso("ts").alias("ts"), "value")


_STATS = """SELECT strftime(c.lo, {iso}) AS lo, m.metric, CASE WHEN count(t.value) = 0 THEN 0 ELSE count(DISTINCT t.us) END AS samples,
 coalesce(round(avg(t.value), 9), 0.0) AS mean, coalesce(max(t.value), 0.0) AS max, coalesce(min(t.value), 0.0) AS min
 FROM c CROSS JOIN m LEFT JOIN tel t ON t.metric = m.metric AND t.us BETWEEN c.us_lo AND c.us_hi GROUP BY 1, 2"""


@query(
    "window_stats",
    with_views(
        f"""WITH c AS (SELECT DISTINCT make_timestamp(us - {WINDOW_S * 1000000}) AS lo, us - {WINDOW_S * 1000000} AS us_lo, us + {WINDOW_S * 1000000} AS us_hi FROM ons),
        m AS (SELECT unnest(['GPU_TEMP', 'POWER_USAGE', 'SM_ACTIVE']) AS metric) """
        + _STATS.format(iso=ISO),
        "ons",
        "tel",
    ),
)
def window_stats(spark, sf_dir):
    """Fleet-wide stats in the two hours either side of each onset."""
    span = F.make_dt_interval(secs=F.lit(WINDOW_S))
    spans = views.onsets(spark, sf_dir).select((F.col("ts") - span).alias("lo"), (F.col("ts") + span).alias("hi"))
    stats = ops.window_stats(views.telemetry(spark, sf_dir), spans, metrics=["GPU_TEMP", "POWER_USAGE", "SM_ACTIVE"])
    return stats.select(iso("lo").alias("lo"), "metric", "samples", F.round("mean", 9).alias("mean"), "max", "min")


@query(
    "populated_cells",
    with_views(
        "SELECT metric, count(value) AS cells FROM tel WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY metric", "tel"
    ),
)
def populated_cells(spark, sf_dir):
    return ops.populated_cells(views.telemetry(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query(
    "namespace_split",
    with_views(
        """SELECT count(*) AS n_gpus, count(*) FILTER (WHERE regexp_matches(gpu, '^[0-9]')) AS ip_named, count(*) FILTER (WHERE gpu LIKE 'lingjun%') AS pod_named
        FROM (SELECT DISTINCT gpu FROM tel WHERE value IS NOT NULL)""",
        "tel",
    ),
)
def namespace_split(spark, sf_dir):
    return ops.namespace_split(views.telemetry(spark, sf_dir))


@query(
    "series_summary",
    with_views("SELECT gpu, metric, min(value) AS min, max(value) AS max, arg_max(value, us) AS last FROM tel WHERE value IS NOT NULL GROUP BY gpu, metric", "tel"),
)
def series_summary(spark, sf_dir):
    return ops.series_summary(views.telemetry(spark, sf_dir))


@query(
    "exporter_fields",
    with_views(
        """SELECT CASE metric WHEN 'POWER_USAGE' THEN 'DCGM_FI_DEV_POWER_USAGE' ELSE 'DCGM_FI_DEV_GPU_TEMP' END AS field, count(*) AS n,
        round(avg(value), 6) AS mean FROM tel WHERE metric IN ('POWER_USAGE', 'GPU_TEMP') GROUP BY 1""",
        "tel",
    ),
)
def exporter_fields(spark, sf_dir):
    seen = ops.exporter_view(views.telemetry(spark, sf_dir))
    return seen.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "device_ids",
    with_views(
        """SELECT DISTINCT node || '-' || gpu_idx AS raw, CASE WHEN node = '10.0.0.3' THEN 'rack-a' ELSE node END AS node, gpu_idx AS idx,
        CASE WHEN node = '10.0.0.3' THEN 'rack-a' ELSE node END || '#' || gpu_idx AS gpu, node || '-' || gpu_idx AS shown FROM ev""",
        "ev",
    ),
)
def device_ids(spark, sf_dir):
    """Raw names parsed on the last dash, one node renamed through the alias table, and rendered back."""
    raw = views.fleet_events(spark, sf_dir).select(F.concat_ws("-", "node", F.col("gpu_idx").cast("string")).alias("raw")).distinct()
    parsed = raw.select("raw", ids.raw_node("raw").alias("node"), ids.raw_index("raw").alias("idx"))
    shown = parsed.withColumn("shown", ids.dash_id(ids.canonical("node", "idx")))
    alias = spark.createDataFrame([("10.0.0.3", "rack-a")], "foreign string, node string")
    return ids.fold_alias(shown, alias).withColumn("gpu", ids.canonical("node", "idx"))


@query("input_files")
def input_files(spark, sf_dir):
    """Files, sizes and states behind the tables this package reads."""
    names = ("events", "orders", "documents", "embeddings", "labels", "conversations")
    files = tables.input_provenance(spark, {n: f"{sf_dir}/{n}.parquet" for n in names})
    return files.groupBy("metric", "state").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
