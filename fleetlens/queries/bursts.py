"""Burst detection and the incident products, on the hourly grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.timeutil import iso
from fleetlens.operators import bursts as ops
from fleetlens.operators import incidents as incident_ops
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import BURST_MIN, COHORT_S, ISO, with_views

W_US = COHORT_S * 1000000
SERIES_S = 43200


@query(
    "cohort_sizes",
    with_views(
        f"""WITH s AS (SELECT us, count(*) AS n FROM gons GROUP BY us)
        SELECT strftime(make_timestamp(us), {ISO}) AS ts, n AS n_onsets,
        CAST(sum(n) OVER (ORDER BY us RANGE BETWEEN {W_US} PRECEDING AND {W_US} FOLLOWING) AS BIGINT) AS cohort FROM s""",
        "gons",
    ),
)
def cohort_sizes(spark, sf_dir):
    return ops.cohort_sizes(views.grid_onsets(spark, sf_dir), COHORT_S).withColumn("ts", iso("ts"))


@query("burst_centers", with_views(f"SELECT strftime(make_timestamp(us), {ISO}) AS center, cohort AS n_onsets FROM ctr", "centers"))
def burst_centers(spark, sf_dir):
    """Greedy burst centres over the whole onset table."""
    found = ops.burst_centers(views.grid_onsets(spark, sf_dir), min_onsets=BURST_MIN, window_s=COHORT_S)
    return found.withColumn("center", iso("center"))


@query(
    "bursts",
    with_views(
        f"""WITH c AS (SELECT center, code, count(*) AS n FROM mem GROUP BY 1, 2),
        t AS (SELECT center, string_agg(code || ':' || n, ',' ORDER BY code) AS codes FROM c GROUP BY 1)
        SELECT strftime(make_timestamp(m.center), {ISO}) AS center, count(*) AS n_onsets, count(DISTINCT gpu) AS n_gpus, count(DISTINCT node) AS n_nodes, any_value(t.codes) AS codes
        FROM mem m JOIN t ON t.center = m.center GROUP BY m.center""",
        "centers",
    ),
)
def bursts(spark, sf_dir):
    rows = ops.bursts(views.grid_onsets(spark, sf_dir), views.centers(spark, sf_dir), COHORT_S)
    text = F.array_join(
        F.transform(F.array_sort(F.map_entries("codes")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ","
    )
    return rows.withColumn("center", iso("center")).withColumn("codes", text)


@query(
    "hero_members",
    with_views(f"SELECT strftime(ts, {ISO}) AS ts, gpu, CAST(code AS INTEGER) AS code FROM mem WHERE center = (SELECT center FROM hero)", "centers"),
)
def hero_members(spark, sf_dir):
    """Members of the largest burst."""
    hero = ops.hero_center(views.centers(spark, sf_dir))
    return ops.cohort_members(views.grid_onsets(spark, sf_dir), hero, COHORT_S).select(iso("ts").alias("ts"), "gpu", "code")


@query(
    "dense_sample_runs",
    with_views(
        f"""WITH d AS (SELECT us, count(*) AS n FROM gons GROUP BY us HAVING count(*) >= 3),
        g AS (SELECT us, n, CASE WHEN us - lag(us) OVER (ORDER BY us) <= {2 * views.GRID_S * 1000000} THEN 0 ELSE 1 END AS brk FROM d),
        r AS (SELECT *, sum(brk) OVER (ORDER BY us) AS run FROM g),
        m AS (SELECT r.run, count(DISTINCT o.node) AS n_nodes FROM r JOIN gons o ON o.us = r.us GROUP BY r.run)
        SELECT strftime(make_timestamp(min(us)), {ISO}) AS first_ts, strftime(make_timestamp(max(us)), {ISO}) AS last_ts, count(*) AS samples, CAST(sum(n) AS BIGINT) AS n_onsets, any_value(m.n_nodes) AS n_nodes
        FROM r JOIN m USING (run) GROUP BY run""",
        "gons",
    ),
)
def dense_sample_runs(spark, sf_dir):
    """Runs of samples with three or more onsets, at most two hours apart."""
    rows = ops.dense_sample_runs(views.grid_onsets(spark, sf_dir), threshold=3, gap_s=2 * views.GRID_S)
    return rows.withColumn("first_ts", iso("first_ts")).withColumn("last_ts", iso("last_ts"))


_LABEL = "CASE code WHEN 43 THEN 'GPU stopped processing' WHEN 31 THEN 'GPU memory page fault' WHEN 45 THEN 'Preemptive cleanup (robust channel)' WHEN 94 THEN 'Contained ECC error' ELSE 'Xid ' || code END"
_CARDS = f"""WITH hm AS (SELECT us, gpu, node, gpu_idx, code FROM mem WHERE center = (SELECT center FROM hero) ORDER BY node, gpu_idx, us, code LIMIT 6),
 iso0 AS (SELECT us, gpu, node, gpu_idx, code, row_number() OVER (PARTITION BY code ORDER BY us, gpu) AS rn FROM gons WHERE gpu NOT IN (SELECT gpu FROM mem)),
 isl AS (SELECT us, gpu, node, gpu_idx, code FROM iso0 WHERE rn = 1 ORDER BY us, gpu LIMIT 4),
 pick AS (SELECT 0 AS part, * FROM hm UNION ALL SELECT 1 AS part, * FROM isl),
 num AS (SELECT *, row_number() OVER (ORDER BY part, CASE WHEN part = 0 THEN node END, CASE WHEN part = 0 THEN gpu_idx END, us, gpu, code) AS seq FROM pick),
 near AS (SELECT n.seq, o.gpu, o.node FROM num n JOIN gons o ON abs(o.us - n.us) <= {W_US}),
 agg AS (SELECT n.seq, count(*) AS correlated_count, count(*) FILTER (WHERE near.node = n.node) - 1 AS node_cofaults FROM num n JOIN near USING (seq) GROUP BY n.seq),
 low AS (SELECT seq, gpu, row_number() OVER (PARTITION BY seq ORDER BY gpu) AS r FROM (SELECT DISTINCT seq, gpu FROM near)),
 lst AS (SELECT n.seq, string_agg(replace(l.gpu, '#', '-'), ',' ORDER BY CASE WHEN l.gpu = n.gpu THEN 0 ELSE 1 END, l.gpu) AS others, bool_or(l.gpu = n.gpu) AS has_own
   FROM num n JOIN low l ON l.seq = n.seq WHERE l.r <= 8 GROUP BY n.seq),
 cards AS (SELECT 'INC-' || lpad(CAST(n.seq AS VARCHAR), 3, '0') AS id, n.us, n.gpu, n.node, n.gpu_idx, n.code, a.node_cofaults, a.correlated_count,
   CASE WHEN has_own THEN others ELSE replace(n.gpu, '#', '-') || ',' || array_to_string(string_split(others, ',')[1:7], ',') END AS correlated,
   part = 0 AND n.gpu = (SELECT gpu FROM num WHERE seq = 1) AS hero, n.part FROM num n JOIN agg a USING (seq) JOIN lst USING (seq))"""


@query(
    "incident_cards",
    with_views(
        _CARDS
        + f""" SELECT id, strftime(make_timestamp(us), {ISO}) AS ts, gpu, CAST(code AS INTEGER) AS code, {_LABEL} AS label, CASE WHEN code IN (31, 48, 79, 95) THEN 'crit' ELSE 'warn' END AS severity,
        node_cofaults, correlated_count, correlated, hero FROM cards""",
        "centers",
    ),
)
def incident_cards(spark, sf_dir):
    """The incident feed: six members of the largest burst and up to four isolated faults."""
    cards = ops.incident_cards(views.grid_onsets(spark, sf_dir), views.centers(spark, sf_dir), COHORT_S)
    return cards.select(
        "id",
        iso("ts").alias("ts"),
        "gpu",
        "code",
        "label",
        "severity",
        F.col("node_cofaults").cast("bigint").alias("node_cofaults"),
        "correlated_count",
        F.array_join("correlated", ",").alias("correlated"),
        "hero",
    )


def _fleet(spark, sf_dir):
    hero = ops.hero_center(views.centers(spark, sf_dir))
    grid = views.grid_telemetry(spark, sf_dir)
    now = grid.where(F.col("ts") == hero.select("center").scalar())
    members = ops.cohort_members(views.grid_onsets(spark, sf_dir), hero, COHORT_S)
    return ops.fleet_snapshot(now.where("metric = 'GPU_TEMP'"), now.where("metric = 'GPU_UTIL'"), members)


_FLEET = """tm AS (SELECT gpu, value AS temp FROM gtel WHERE metric = 'GPU_TEMP' AND us = (SELECT center FROM hero)),
 ut AS (SELECT gpu, value AS util FROM gtel WHERE metric = 'GPU_UTIL' AND us = (SELECT center FROM hero)),
 hf AS (SELECT gpu, arg_max(code, us * 1000 + code) AS xid FROM mem WHERE center = (SELECT center FROM hero) GROUP BY gpu),
 ids AS (SELECT gpu FROM tm UNION SELECT gpu FROM ut UNION SELECT gpu FROM hf),
 fleet AS (SELECT split_part(ids.gpu, '#', 1) AS node, CAST(split_part(ids.gpu, '#', 2) AS INTEGER) AS gpu_idx, coalesce(temp, 0.0) AS temp, coalesce(util, 0.0) AS util,
   CAST(coalesce(xid, 0) AS INTEGER) AS xid, CASE WHEN xid IS NOT NULL THEN 'fault' WHEN util IS NULL OR util <= 0 THEN 'idle' ELSE 'active' END AS status
   FROM ids LEFT JOIN tm ON tm.gpu = ids.gpu LEFT JOIN ut ON ut.gpu = ids.gpu LEFT JOIN hf ON hf.gpu = ids.gpu)"""


@query("fleet_snapshot", with_views("WITH " + _FLEET + " SELECT * FROM fleet", "centers", "gtel"))
def fleet_snapshot(spark, sf_dir):
    return _fleet(spark, sf_dir)


_OVER = """, lt AS (SELECT node, gpu_idx, arg_max(code, us || id) AS c FROM cards GROUP BY 1, 2)
 SELECT f.node, f.gpu_idx, f.temp, f.util, CAST(coalesce(lt.c, f.xid) AS INTEGER) AS xid, CASE WHEN lt.c IS NOT NULL THEN 'fault' ELSE f.status END AS status
 FROM fleet f LEFT JOIN lt ON lt.node = f.node AND lt.gpu_idx = f.gpu_idx"""


@query("fleet_overlay", with_views(_CARDS + ", " + _FLEET + _OVER, "centers", "gtel"))
def fleet_overlay(spark, sf_dir):
    """Fleet cells after the incident cards have arrived."""
    return ops.overlay_incidents(_fleet(spark, sf_dir), views.cards(spark, sf_dir))


@query(
    "heatmap",
    with_views(
        "WITH " + _FLEET + """ SELECT node, count(*) AS n_cells, count(*) FILTER (WHERE status = 'fault') AS faults,
        string_agg(gpu_idx || '=' || status, ',' ORDER BY gpu_idx) AS cells FROM fleet GROUP BY node""",
        "centers",
        "gtel",
    ),
)
def heatmap(spark, sf_dir):
    rows = ops.heatmap(_fleet(spark, sf_dir))
    text = F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["gpu_idx"].cast("string"), c["status"])), ",")
    return rows.select("node", F.size("cells").cast("bigint").alias("n_cells"), "faults", text.alias("cells"))


@query("board_counts", with_views(_CARDS + " SELECT count(*) AS triaging, count(DISTINCT node) AS nodes_hit FROM cards", "centers"))
def board_counts(spark, sf_dir):
    return ops.board_counts(views.cards(spark, sf_dir))


@query(
    "incident_series",
    with_views(
        _CARDS
        + f""", s AS (SELECT c.id, c.us AS center, c.gpu, t.metric, string_agg(strftime(make_timestamp(t.us), {ISO}) || '=' || printf('%.2f', t.value), ';' ORDER BY t.us) AS pts
        FROM cards c JOIN tel t ON t.gpu = c.gpu AND t.us BETWEEN c.us - {SERIES_S * 1000000} AND c.us + {SERIES_S * 1000000} GROUP BY 1, 2, 3, 4)
        SELECT c.id, replace(c.gpu, '#', '-') AS gpu, strftime(make_timestamp(c.us), {ISO}) AS center_ts,
        coalesce(max(s.pts) FILTER (WHERE metric = 'GPU_TEMP'), '') AS temp, coalesce(max(s.pts) FILTER (WHERE metric = 'POWER_USAGE'), '') AS power, coalesce(max(s.pts) FILTER (WHERE metric = 'GPU_UTIL'), '') AS util
        FROM cards c LEFT JOIN s ON s.id = c.id GROUP BY c.id, c.gpu, c.us""",
        "centers",
        "tel",
    ),
)
def incident_series(spark, sf_dir):
    """Temperature, power and utilisation series around each card's onset."""
    rows = ops.incident_series(
        views.cards(spark, sf_dir),
        views.telemetry(spark, sf_dir),
        {"temp": "GPU_TEMP", "power": "POWER_USAGE", "util": "GPU_UTIL"},
        SERIES_S,
    )

    def text(name):
        return F.array_join(
            F.transform(f"series.{name}", lambda p: F.concat_ws("=", iso(p["ts"]), F.format_string("%.2f", p["value"]))), ";"
        ).alias(name)

    return rows.select("id", "gpu", iso("center_ts").alias("center_ts"), text("temp"), text("power"), text("util"))


@query(
    "hero_meta",
    with_views(
        f"""SELECT strftime(make_timestamp(max(center)) - INTERVAL 20 MINUTES, {ISO}) AS window_start, strftime(make_timestamp(max(center)) + INTERVAL 20 MINUTES, {ISO}) AS window_end,
        strftime(make_timestamp(max(center)), {ISO}) AS cascade_ts, (SELECT count(DISTINCT gpu) FROM gauge) AS total_gpus, count(*) AS faulted, count(DISTINCT node) AS nodes_affected, 'events' AS source
        FROM mem WHERE center = (SELECT center FROM hero)""",
        "centers",
    ),
)
def hero_meta(spark, sf_dir):
    fleet = views.gauge(spark, sf_dir).agg(F.count_distinct("gpu"))
    row = ops.hero_meta(
        views.grid_onsets(spark, sf_dir), ops.hero_center(views.centers(spark, sf_dir)), fleet, "events", COHORT_S
    )
    for c in ("window_start", "window_end", "cascade_ts"):
        row = row.withColumn(c, iso(c))
    return row


@query(
    "product_manifest",
    with_views(
        _CARDS
        + f""" SELECT 'fleet-products/v1' AS schema, 'events' AS source, {views.GRID_S} AS sample_period_seconds, (SELECT count(*) FROM gons) AS onset_total, (SELECT count(*) FROM ctr) AS burst_count,
        (SELECT count(*) FROM cards) AS incident_count, (SELECT strftime(make_timestamp(center), {ISO}) FROM hero) AS hero_center,
        (SELECT nullif(count(*), 0) FROM mem WHERE center = (SELECT center FROM hero)) AS hero_onsets""",
        "centers",
    ),
)
def product_manifest(spark, sf_dir):
    row = ops.manifest(
        views.grid_onsets(spark, sf_dir), views.centers(spark, sf_dir), views.cards(spark, sf_dir), "events", views.GRID_S, COHORT_S
    )
    return row.select(
        "schema", "source", "sample_period_seconds", "onset_total", "burst_count", "incident_count",
        iso("hero.center").alias("hero_center"), F.col("hero.n_onsets").alias("hero_onsets"),
    )


@query(
    "onset_incidents",
    with_views(
        f"SELECT gpu || '@' || strftime(ts, {ISO}) AS incident_id, 'xid_onset' AS source, gpu, strftime(ts, {ISO}) AS fail_time, CAST(code AS DOUBLE) AS xid FROM ons", "ons"
    ),
)
def onset_incidents(spark, sf_dir):
    rows = incident_ops.from_onsets(views.onsets(spark, sf_dir))
    return rows.select("incident_id", "source", "gpu", "fail_time", F.col("observed.xid").alias("xid"))


@query(
    "canonical_jobs",
    with_views(
        f"""SELECT job_id AS incident_id, 'job_trace' AS source, CAST(NULL AS VARCHAR) AS gpu, strftime(fail_ts, '%Y-%m-%d %H:%M:%S') AS fail_time, CAST(NULL AS DOUBLE) AS xid, type AS detail_type FROM jobs
        WHERE state IN ('FAILED', 'NODE_FAIL')""",
        "jobs",
    ),
)
def canonical_jobs(spark, sf_dir):
    """Job failures in the common incident shape."""
    jobs = views.order_jobs(spark, sf_dir).where("state IN ('FAILED', 'NODE_FAIL')").select("job_id", "type", "state", "fail_time")
    rows = incident_ops.canonical(jobs)
    return rows.select("incident_id", "source", "gpu", "fail_time", F.col("observed.xid").alias("xid"), F.col("details")["type"].alias("detail_type"))
