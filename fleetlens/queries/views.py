"""The given tables seen as fleet telemetry, and the same views in SQL.

``events`` plays the fleet: a user is a device (eight per node), an event is a reading of
the metric its type maps to, and the fault gauge reads ``error`` as a fault code,
``signup`` as an idle cell and anything else as healthy. ``orders`` plays the job trace.
Events are sparse (about two per user and day), so windows are hours, not seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.timeutil import on_grid
from fleetlens.operators import onsets as onset_ops
from fleetlens.operators.bursts import burst_centers, incident_cards
from fleetlens.operators.features import labelled_points
from fleetlens.operators.telemetry import rename_metrics, resample
from fleetlens.session import derived_table

METRIC_OF_EVENT = {
    "view": "GPU_TEMP",
    "click": "POWER_USAGE",
    "purchase": "GPU_UTIL",
    "signup": "MEMORY_TEMP",
    "error": "MEM_CLOCK",
}
FEATURE_METRICS = ("GPU_TEMP", "POWER_USAGE", "GPU_UTIL", "MEMORY_TEMP")
HORIZONS_S = (21600.0, 43200.0, 86400.0)
LOOKBACK_S = 172800.0
NEG_OFFSET_S = 129600.0
PERIOD_S = 21600.0
CONTROL_GPUS = ("10.0.0.0#0", "10.0.0.1#3")
GRID_S = 3600
COHORT_S = 10800
BURST_MIN = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.expr("user_id div 8")
    node = F.concat_ws(".", F.lit("10.0"), F.expr("(user_id div 8) div 256"), rank % 256)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        node.alias("node"),
        (F.col("user_id") % 8).cast("int").alias("gpu_idx"),
        F.concat_ws("#", node, F.col("user_id") % 8).alias("gpu"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fleet_events(spark, sf_dir).select("ts", "node", "gpu_idx", "gpu", F.col("event_type").alias("metric"), "value")
    return rename_metrics(raw, METRIC_OF_EVENT)


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (
        F.when(F.col("event_type") == "error", F.element_at(F.array(*[F.lit(float(c)) for c in (43, 31, 94, 45)]), F.col("k") % 4 + 1))
        .when(F.col("event_type") == "signup", F.lit(None))
        .otherwise(0.0)
    )
    return fleet_events(spark, sf_dir).select("ts", "node", "gpu_idx", "gpu", code.alias("code"))


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset table, written once per source and application."""
    return derived_table(spark, sf_dir, "onsets", lambda: onset_ops.onsets(gauge(spark, sf_dir)))


def grid_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets by the hour they fall in, for what counts onsets per sample; none is merged."""
    return onsets(spark, sf_dir).withColumn("ts", on_grid("ts", GRID_S))


def grid_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading per device, metric and hour: what a whole fleet shows at one sample."""
    return resample(telemetry(spark, sf_dir), GRID_S)


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_table(
        spark,
        sf_dir,
        "centers",
        lambda: burst_centers(grid_onsets(spark, sf_dir), min_onsets=BURST_MIN, window_s=COHORT_S),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_table(
        spark, sf_dir, "cards", lambda: incident_cards(grid_onsets(spark, sf_dir), centers(spark, sf_dir), COHORT_S)
    )


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a job trace with text times (day grain, many equal times)."""
    state = (
        F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "NODE_FAIL").otherwise("COMPLETED")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("type"),
        state.alias("state"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("fail_time"),
        F.col("o_totalprice").alias("gpu_time"),
        F.col("o_custkey").cast("double").alias("gpu_num"),
    )


def fleet_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as failed jobs that ran for the two hours after their time."""
    return (
        fleet_events(spark, sf_dir)
        .where("event_type = 'purchase'")
        .select(
            F.col("event_id").cast("string").alias("job_id"),
            F.lit("FAILED").alias("state"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fail_time"),
            F.col("ts").alias("fail_ts"),
            F.col("ts").alias("start_ts"),
            (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_ts"),
        )
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled dataset, written once per source and application."""
    return derived_table(
        spark,
        sf_dir,
        "points",
        lambda: labelled_points(
            onsets(spark, sf_dir),
            telemetry(spark, sf_dir),
            metrics=FEATURE_METRICS,
            horizons_s=HORIZONS_S,
            lookback_s=LOOKBACK_S,
            neg_offset_s=NEG_OFFSET_S,
            control_gpus=CONTROL_GPUS,
            period_s=PERIOD_S,
        ),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points with a plain score: the last temperature, 0 when there is none (many ties)."""
    return points(spark, sf_dir).withColumn("score", F.coalesce("GPU_TEMP_last", F.lit(0.0)))


# --- the same views in SQL -----------------------------------------------------------------

ISO = "'%Y-%m-%d %H:%M:%S.%f'"

_EV = """ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  '10.0.' || ((user_id // 8) // 256) || '.' || ((user_id // 8) % 256) AS node,
  CAST(user_id % 8 AS INTEGER) AS gpu_idx,
  '10.0.' || ((user_id // 8) // 256) || '.' || ((user_id // 8) % 256) || '#' || (user_id % 8) AS gpu FROM events)"""
_TEL = """tel AS (SELECT ts, us, node, gpu_idx, gpu, CASE event_type WHEN 'view' THEN 'GPU_TEMP' WHEN 'click' THEN 'POWER_USAGE'
  WHEN 'purchase' THEN 'GPU_UTIL' WHEN 'signup' THEN 'MEMORY_TEMP' WHEN 'error' THEN 'MEM_CLOCK' END AS metric, value FROM ev)"""
_GAUGE = """gauge AS (SELECT ts, us, node, gpu_idx, gpu, CASE WHEN event_type = 'error' THEN
  CASE k % 4 WHEN 0 THEN 43 WHEN 1 THEN 31 WHEN 2 THEN 94 ELSE 45 END WHEN event_type = 'signup' THEN NULL ELSE 0 END AS code FROM ev)"""
_ONS = """ons AS (SELECT ts, us, node, gpu_idx, gpu, code FROM (SELECT *, lag(code) OVER w AS prev, row_number() OVER w AS rn
  FROM gauge WINDOW w AS (PARTITION BY gpu ORDER BY ts)) WHERE code <> 0 AND rn > 1 AND (prev IS NULL OR prev = 0))"""
_GONS = f"""gons AS (SELECT us - us % {GRID_S * 1000000} AS us, make_timestamp(us - us % {GRID_S * 1000000}) AS ts,
  node, gpu_idx, gpu, code FROM ons)"""
_GTEL = f"""gtel AS (SELECT us - us % {GRID_S * 1000000} AS us, make_timestamp(us - us % {GRID_S * 1000000}) AS ts, node, gpu_idx, gpu, metric,
  arg_max(value, us) AS value FROM tel WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)"""
_H = ", ".join(str(h) for h in HORIZONS_S)
_CAND = f"""hz AS (SELECT unnest([{_H}]::DOUBLE[]) AS horizon_s),
o2 AS (SELECT DISTINCT gpu, us FROM ons),
pos AS (SELECT gpu, us - CAST(horizon_s * 1000000 AS BIGINT) AS ref, horizon_s, 1 AS positive FROM o2, hz),
neg AS (SELECT gpu, us - {int(NEG_OFFSET_S * 1e6)} AS ref, horizon_s, 0 AS positive FROM o2, hz),
ctl AS (SELECT c.gpu, p.ref, p.horizon_s, 0 AS positive FROM (SELECT DISTINCT ref, horizon_s FROM pos) p,
  (SELECT unnest([{", ".join(repr(g) for g in CONTROL_GPUS)}]) AS gpu) c),
pool AS (SELECT gpu, ref, horizon_s, max(positive) AS positive FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg UNION ALL SELECT * FROM ctl)
  GROUP BY 1, 2, 3),
cand AS (SELECT p.gpu, p.ref, p.horizon_s, p.positive, max(CASE WHEN o.us IS NULL THEN 0 ELSE 1 END) AS label FROM pool p LEFT JOIN o2 o
  ON o.gpu = p.gpu AND o.us > p.ref AND o.us <= p.ref + CAST(p.horizon_s * 1000000 AS BIGINT) GROUP BY 1, 2, 3, 4
  HAVING p.positive = 1 OR label = 0)"""


def _stat_sql(metric: str) -> str:
    f = f"FILTER (WHERE t.metric = '{metric}')"
    expected = LOOKBACK_S / PERIOD_S + 1.0
    cols = {
        "count": f"count(t.value) {f}",
        "coverage": f"count(t.value) {f} / {expected}::DOUBLE",
        "present": f"CAST(count(t.value) {f} > 0 AS INTEGER)",
        "mean": f"avg(t.value) {f}",
        "std": f"stddev_pop(t.value) {f}",
        "min": f"min(t.value) {f}",
        "max": f"max(t.value) {f}",
        "last": f"arg_max(t.value, t.us) {f}",
        "delta": f"arg_max(t.value, t.us) {f} - arg_min(t.value, t.us) {f}",
        "slope": f"CASE WHEN count(t.value) {f} > 1 THEN regr_slope(t.value, (t.us - c.ref) / 1000000.0) {f} END",
    }
    return ", ".join(f"{expr} AS {metric}_{stat}" for stat, expr in cols.items())


_PTS = f"""feat AS (SELECT c.gpu, c.ref, {", ".join(_stat_sql(m) for m in FEATURE_METRICS)}
  FROM (SELECT DISTINCT gpu, ref FROM cand) c JOIN tel t ON t.gpu = c.gpu AND t.us BETWEEN c.ref - {int(LOOKBACK_S * 1e6)} AND c.ref
  WHERE t.value IS NOT NULL AND t.metric IN ({", ".join(repr(m) for m in FEATURE_METRICS)}) GROUP BY 1, 2),
pts AS (SELECT c.gpu, split_part(c.gpu, '#', 1) AS node, CAST(split_part(c.gpu, '#', 2) AS INTEGER) AS gpu_idx, c.ref,
  'XID_ERRORS' AS event_source, c.horizon_s, {LOOKBACK_S}::DOUBLE AS lookback_s, c.label, f.* EXCLUDE (gpu, ref)
  FROM cand c JOIN feat f ON f.gpu = c.gpu AND f.ref = c.ref)"""
_SCORED = """scored AS (SELECT *, coalesce(GPU_TEMP_last, 0.0) AS score,
  ('0x' || substr(md5(gpu || '|' || ref || '|' || CAST(horizon_s AS BIGINT)), 1, 12))::BIGINT AS tie FROM pts)"""
_JOBS = """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey AS seq, o_orderpriority AS type,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'NODE_FAIL' ELSE 'COMPLETED' END AS state,
  epoch_us(o_orderdate) AS us, o_orderdate AS fail_ts, o_totalprice AS gpu_time, CAST(o_custkey AS DOUBLE) AS gpu_num FROM orders)"""
_FJOBS = """fjobs AS (SELECT CAST(event_id AS VARCHAR) AS job_id, us, ts FROM ev WHERE event_type = 'purchase')"""
# greedy burst centres: walk the samples in order of strength, keep one that no kept one is near
_CENTERS = f"""smp AS (SELECT us, count(*) AS n FROM gons GROUP BY us),
coh AS (SELECT us, n, sum(n) OVER (ORDER BY us RANGE BETWEEN {COHORT_S * 1000000} PRECEDING AND {COHORT_S * 1000000} FOLLOWING) AS cohort FROM smp),
cnd AS (SELECT us, cohort, row_number() OVER (ORDER BY cohort DESC, us) AS r FROM coh WHERE cohort >= {BURST_MIN}),
walk(r, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT c.r, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - c.us) <= {COHORT_S * 1000000})) = 0 THEN list_append(w.kept, c.us) ELSE w.kept END
  FROM walk w JOIN cnd c ON c.r = w.r + 1),
ctr AS (SELECT k.us AS us, CAST(c.cohort AS BIGINT) AS cohort FROM (SELECT unnest(kept) AS us FROM walk WHERE r = (SELECT max(r) FROM walk)) k
  JOIN cnd c ON c.us = k.us),
mem AS (SELECT c.us AS center, c.cohort, o.* FROM ctr c JOIN gons o ON abs(o.us - c.us) <= {COHORT_S * 1000000}),
hero AS (SELECT us AS center FROM ctr ORDER BY cohort DESC, us LIMIT 1)"""


_CHAIN = {
    "ev": _EV,
    "tel": _TEL,
    "gauge": _GAUGE,
    "ons": _ONS,
    "gons": _GONS,
    "gtel": _GTEL,
    "cand": _CAND,
    "pts": _PTS,
    "scored": _SCORED,
    "jobs": _JOBS,
    "fjobs": _FJOBS,
    "centers": _CENTERS,
}
_NEEDS = {
    "tel": ["ev"],
    "gauge": ["ev"],
    "ons": ["gauge"],
    "gons": ["ons"],
    "gtel": ["tel"],
    "cand": ["ons"],
    "pts": ["cand", "tel"],
    "scored": ["pts"],
    "fjobs": ["ev"],
    "centers": ["gons"],
}


def half_even(expr: str, digits: int) -> str:
    """SQL for rounding a double half to even on its decimal form, as ``bround`` does."""
    scaled = f"CAST(CAST({expr} AS VARCHAR) AS DECIMAL(36, 17)) * {10**digits}"
    whole = f"floor({scaled})"
    rest = f"({scaled} - {whole})"
    up = f"({rest} > 0.5 OR ({rest} = 0.5 AND {whole} % 2 = 1))"
    return f"CAST(({whole} + CASE WHEN {up} THEN 1 ELSE 0 END) AS DOUBLE) / {10**digits}"


def with_views(body: str, *names: str) -> str:
    """``body`` behind the common table expressions it names (and what those need)."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    extra = ""
    text = body.strip()
    if text.upper().startswith("WITH "):
        extra, text = ", " + text[5:], ""
    return "WITH RECURSIVE " + ",\n".join(_CHAIN[n] for n in ordered) + (extra if extra else "\n" + text)
