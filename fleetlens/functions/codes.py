"""Fault-code vocabulary and numeric clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, label on cards, meaning in reports, group in reports.
FAULT_CODES = (
    (31, "GPU memory page fault", "GPU memory page fault (MMU / illegal address)", "memory_fault"),
    (43, "GPU stopped processing", "GPU stopped processing (fell off bus / hang)", "fatal_hang"),
    (45, "Preemptive cleanup (robust channel)", "Preemptive cleanup (robust channel; often app-induced)", "soft_cleanup"),
    (48, "Double-bit ECC error", "Double-bit ECC error", "fatal_ecc"),
    (79, "GPU has fallen off the bus", "GPU has fallen off the bus", "fatal_hang"),
    (94, "Contained ECC error", "Contained ECC error", "contained_ecc"),
    (95, "Uncontained ECC error", "Uncontained ECC error", "fatal_ecc"),
)
# Codes shown as critical on cards; all others are warnings.
CRITICAL_CODES = (31, 48, 79, 95)
# Job states that count as a failure.
FAIL_STATES = ("NODE_FAIL", "FAILED")
# Metric names, and the exporter field names that map onto them.
METRICS = ("XID_ERRORS", "GPU_TEMP", "POWER_USAGE", "GPU_UTIL", "MEMORY_TEMP", "MEM_CLOCK", "SM_ACTIVE")
EXPORTER_FIELDS = {
    "DCGM_FI_DEV_POWER_USAGE": "POWER_USAGE",
    "DCGM_FI_DEV_GPU_TEMP": "GPU_TEMP",
}


def code_dimension(spark: SparkSession) -> DataFrame:
    """Seven rows: ``code, label, severity, meaning, code_group``."""
    rows = [(c, label, "crit" if c in CRITICAL_CODES else "warn", meaning, group) for c, label, meaning, group in FAULT_CODES]
    return spark.createDataFrame(rows, "code int, label string, severity string, meaning string, code_group string")


def with_code_attributes(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``label, severity`` (cards) and ``meaning, code_group`` (reports) with both default rules."""
    dim = F.broadcast(code_dimension(df.sparkSession).withColumnRenamed("code", "_code"))  # 7 rows
    return (
        df.join(dim, F.col(code) == F.col("_code"), "left")
        .drop("_code")
        .withColumn("label", F.coalesce("label", F.concat(F.lit("Xid "), F.col(code).cast("string"))))
        .withColumn("severity", F.coalesce("severity", F.lit("warn")))
        .withColumn("meaning", F.coalesce("meaning", F.lit("unknown")))
        .withColumn("code_group", F.coalesce("code_group", F.lit("unknown")))
    )


def integral_code(value: str | Column) -> Column:
    """A whole-number code without its decimal point, others unchanged, as text."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def sensed_code(raw: str | Column) -> Column:
    """Text cell to a sensed code: blank, ``nan`` and non-numbers are unobserved (NULL)."""
    text = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    return F.when(F.lower(text) == "nan", F.lit(None)).otherwise(text.try_cast("double"))


def nan_to_null(value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v), v)


def metric_field(metric: str | Column) -> Column:
    """Exporter field name of a metric (NULL for metrics no exporter field maps to)."""
    m = F.col(metric) if isinstance(metric, str) else metric
    out = F.lit(None).cast("string")
    for field, name in EXPORTER_FIELDS.items():
        out = F.when(m == name, F.lit(field)).otherwise(out)
    return out
