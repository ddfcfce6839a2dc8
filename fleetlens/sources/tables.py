"""Job traces, sidecar-header text, labelled tables, provenance and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job trace text with its fixed header; every column arrives as text."""
    return spark.read.schema(schemas.JOBS).option("header", True).option("enforceSchema", False).csv(path)


def read_sidecar_csv(spark: SparkSession, path: str, header_path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Headerless text whose column names live in a separate one-line file."""
    line = spark.read.text(header_path).first()
    names = [c.strip() for c in line.value.split(",")]
    schema = ", ".join(f"`{n}` {(types or {}).get(n, 'string')}" for n in names)
    return spark.read.schema(schema).csv(path)


def read_points(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Labelled table, Parquet or text by suffix (text needs a schema)."""
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a text table needs an explicit schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def points_layout(df: DataFrame) -> DataFrame:
    """Meta columns first, features after them in name order."""
    meta = [c for c in schemas.POINT_META if c in df.columns]
    return df.select(*meta, *sorted(schemas.feature_columns(df.columns)))


def write_points(df: DataFrame, path: str) -> str:
    """Write a labelled table, Parquet unless the path ends in ``.csv``."""
    out = points_layout(df).write.mode("overwrite")
    if path.rstrip("/").endswith(".csv"):
        out.option("header", True).csv(path)
    else:
        out.parquet(path)
    return path


def input_provenance(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``metric, path, size, modified, state`` per source file, from the files' metadata only.

    A source that cannot be listed is reported as ``absent``.
    """
    out = None
    for metric, path in paths.items():
        try:
            files = (
                spark.read.format("binaryFile")
                .load(path)
                .select(
                    F.lit(metric).alias("metric"),
                    "path",
                    F.col("length").alias("size"),
                    F.col("modificationTime").alias("modified"),
                    F.lit("present").alias("state"),
                )
            )
        except AnalysisException:  # an absent source is a row in the report, not a failure
            files = spark.createDataFrame(
                [(metric, path, None, None, "absent")],
                "metric string, path string, size bigint, modified timestamp, state string",
            )
        out = files if out is None else out.unionByName(files)
    return out


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of a dataset: the file's own digest, or a hash tree over the digests of many files."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d"))
    groups = files.groupBy(F.substring("d", 1, 3).alias("g")).agg(
        F.count("*").alias("n"),
        F.max("d").alias("one"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("gd"),
    )
    # at most 4,096 group digests meet here
    tree = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "gd"))), lambda x: F.concat(x["g"], F.lit(":"), x["gd"])), "\n")
    whole = groups.agg(F.sum("n").alias("n_files"), F.max("one").alias("_one"), F.sha2(tree, 256).alias("_tree"))
    return whole.select("n_files", F.when(F.col("n_files") == 1, F.col("_one")).otherwise(F.col("_tree")).alias("dataset_sha256"))


def first_available(spark: SparkSession, candidates: Sequence[tuple[str, str]]) -> DataFrame | None:
    """The first readable Parquet of ``(path, badge)``, its badge in ``data_source``; else None."""
    for path, badge in candidates:
        try:
            return spark.read.parquet(path).withColumn("data_source", F.lit(badge))
        except AnalysisException:  # absent: try the next
            continue
    return None
