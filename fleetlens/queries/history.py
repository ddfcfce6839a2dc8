"""Job history, telemetry per job and design matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import jobs as ops
from fleetlens.operators import metrics
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import with_views

N_FAIL = 500
START = 5000


@query(
    "warm_start",
    with_views(
        f"""WITH c AS (SELECT *, sum(CASE WHEN state <> 'COMPLETED' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS f FROM jobs),
        cut AS (SELECT min(seq) AS s FROM c WHERE f = {N_FAIL}) SELECT job_id, state FROM jobs WHERE seq <= coalesce((SELECT s FROM cut), seq)""",
        "jobs",
    ),
)
def warm_start(spark, sf_dir):
    """History up to the 500th failure."""
    return ops.warm_start(views.order_jobs(spark, sf_dir), N_FAIL, "seq").select("job_id", "state")


@query(
    "replay",
    with_views(f"SELECT job_id, state FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM jobs) WHERE rn > {START}", "jobs"),
)
def replay(spark, sf_dir):
    """Jobs from position 5000 on."""
    return ops.replay_from(views.order_jobs(spark, sf_dir), START, "seq").select("job_id", "state")


_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "design_matrix",
    with_views(
        "SELECT seq, gpu_num, gpu_time, CASE WHEN state IN ('FAILED', 'NODE_FAIL') THEN 1 ELSE 0 END AS label, "
        + ", ".join(f'CASE WHEN type = \'{t}\' THEN 1 ELSE 0 END AS "type_{t}"' for t in _TYPES)
        + " FROM jobs",
        "jobs",
    ),
)
def design_matrix(spark, sf_dir):
    """Numeric columns, one-hot job type and the failure label."""
    return ops.design_matrix(views.order_jobs(spark, sf_dir), ["gpu_num", "gpu_time", "type"], keep=["seq"])


_SPLIT = """s AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n, CASE WHEN state IN ('FAILED', 'NODE_FAIL') THEN 1 ELSE 0 END AS label FROM jobs)"""


@query(
    "row_split",
    with_views(
        f"WITH {_SPLIT} SELECT CAST(count(*) FILTER (WHERE rn <= floor(n * 0.7)) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE rn > floor(n * 0.7)) AS BIGINT) AS n_val FROM s", "jobs"
    ),
)
def row_split(spark, sf_dir):
    """Sizes of the row-order split."""
    rows = metrics.row_order_split(views.order_jobs(spark, sf_dir), "seq")
    return rows.agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_val"))


@query(
    "class_balance",
    with_views(
        f"""WITH {_SPLIT} SELECT count(*) FILTER (WHERE rn <= floor(n * 0.7)) AS n_train, count(*) FILTER (WHERE rn > floor(n * 0.7)) AS n_val,
        count(DISTINCT label) FILTER (WHERE rn <= floor(n * 0.7)) AS train_classes, count(DISTINCT label) FILTER (WHERE rn > floor(n * 0.7)) AS val_classes,
        count(DISTINCT label) FILTER (WHERE rn <= floor(n * 0.7)) >= 2 AND count(DISTINCT label) FILTER (WHERE rn > floor(n * 0.7)) >= 2 AS balanced FROM s""",
        "jobs",
    ),
)
def class_balance(spark, sf_dir):
    rows = ops.design_matrix(views.order_jobs(spark, sf_dir), ["gpu_num"], keep=["seq"])
    return metrics.class_balance(metrics.row_order_split(rows, "seq"))


_AGG = ", ".join(
    f"""coalesce(round(avg(t.value) FILTER (WHERE t.metric = '{m}'), 9), 0.0) AS {p}_mean, coalesce(max(t.value) FILTER (WHERE t.metric = '{m}'), 0.0) AS {p}_max,
    coalesce(round(stddev_pop(t.value) FILTER (WHERE t.metric = '{m}'), 4), 0.0) AS {p}_std"""
    for p, m in (("power", "POWER_USAGE"), ("temp", "GPU_TEMP"), ("util", "GPU_UTIL"))
)
_SIGNALS = {"power": "POWER_USAGE", "temp": "GPU_TEMP", "util": "GPU_UTIL"}


def _features(spark, sf_dir):
    rows = ops.job_features(views.fleet_jobs(spark, sf_dir), views.telemetry(spark, sf_dir), _SIGNALS)
    out = rows.select("job_id", *[c for c in rows.columns if c.startswith(ops.JOB_PREFIXES)])
    for p in _SIGNALS:
        out = out.withColumn(f"{p}_mean", F.round(f"{p}_mean", 9)).withColumn(f"{p}_std", F.round(f"{p}_std", 4))
    return out


@query(
    "job_features",
    with_views(f"SELECT j.job_id, {_AGG} FROM fjobs j LEFT JOIN tel t ON t.us BETWEEN j.us AND j.us + 7200000000 GROUP BY j.job_id", "fjobs", "tel"),
)
def job_features(spark, sf_dir):
    """Fleet-wide power, temperature and utilisation during every job."""
    return _features(spark, sf_dir)


@query(
    "job_sensory",
    with_views(
        f"""SELECT {_AGG} FROM fjobs j LEFT JOIN tel t ON t.us BETWEEN j.us AND j.us + 7200000000
        WHERE j.job_id = (SELECT CAST(max(event_id) AS VARCHAR) FROM ev WHERE event_type = 'purchase') GROUP BY j.job_id""",
        "fjobs",
        "tel",
    ),
)
def job_sensory(spark, sf_dir):
    """Telemetry columns of the newest job."""
    last = views.fleet_jobs(spark, sf_dir).agg(F.max(F.col("job_id").cast("bigint"))).first()[0]
    return ops.sensory(_features(spark, sf_dir), str(last))


