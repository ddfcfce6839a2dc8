"""The incident products as JSON datasets: write, check, read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# The product documents; series are optional.
REQUIRED = ("manifest", "meta", "fleet", "incidents")
SERIES = "telemetry"

SCHEMAS = {
    "incidents": (
        "id string, ts timestamp, gpu string, node string, gpu_idx int, code int, label string, severity string, "
        "node_cofaults bigint, correlated_count bigint, correlated array<string>, hero boolean, state string"
    ),
    "fleet": "node string, gpu_idx int, temp double, util double, xid int, status string",
    "meta": (
        "window_start timestamp, window_end timestamp, cascade_ts timestamp, total_gpus bigint, faulted bigint, "
        "nodes_affected bigint, source string"
    ),
    "manifest": (
        "schema string, source string, sample_period_seconds int, onset_total bigint, burst_count bigint, "
        "hero struct<center: timestamp, n_onsets: bigint, n_gpus: bigint, n_nodes: bigint, codes: map<string, bigint>>, incident_count bigint"
    ),
    SERIES: (
        "id string, gpu string, center_ts timestamp, series struct<temp: array<struct<ts: timestamp, value: double>>, "
        "power: array<struct<ts: timestamp, value: double>>, util: array<struct<ts: timestamp, value: double>>>"
    ),
}


def write_products(products: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Overwrite one JSON dataset per product, so nothing stale remains; the manifest goes last.

    A reader that finds the manifest finds the other documents complete.
    """
    missing = [n for n in REQUIRED if n not in products]
    if missing:
        raise ValueError(f"products missing: {missing}")
    paths = {}
    for name in [*[n for n in products if n != "manifest"], "manifest"]:
        paths[name] = f"{root.rstrip('/')}/{name}"
        products[name].write.mode("overwrite").json(paths[name])
    return paths


def available(spark: SparkSession, root: str) -> bool:
    """True when all required documents are there."""
    for name in REQUIRED:
        try:
            spark.read.schema(SCHEMAS[name]).json(f"{root.rstrip('/')}/{name}").limit(1).count()
        except AnalysisException:  # no such path
            return False
    return True


def read_products(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All documents under their schemas; incomplete products are an error."""
    if not available(spark, root):
        raise FileNotFoundError(f"incomplete products under {root}")
    out = {name: spark.read.schema(SCHEMAS[name]).json(f"{root.rstrip('/')}/{name}") for name in REQUIRED}
    try:
        series = spark.read.schema(SCHEMAS[SERIES]).json(f"{root.rstrip('/')}/{SERIES}")
        series.limit(1).count()
        out[SERIES] = series
    except AnalysisException:  # optional
        pass
    return out
