"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: For the fleet queries: shuffles are cut finely and adaptive execution puts small pieces together, so a task's
#: share, and with it the memory of its sorts and aggregations, doesn't grow with the input.
FINE_SHUFFLES = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "480",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession, **more: str) -> None:
    """Set the defaults that may change on a running session (a session made elsewhere)."""
    for key, value in (DEFAULT_CONF | more).items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; a cluster
    without it is refused, since a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlens-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where a plan reads one input several times: the copy is columnar (later
    reads prune columns), survives executor loss and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


def derived_table(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """``build()`` written once per application, source folder and name, then reused."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _DERIVED:
        _DERIVED[key] = materialize(build(), name)
    return _DERIVED[key]
