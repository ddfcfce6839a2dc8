"""Rising edges of a per-device gauge, found in time chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.intervals import MICROS, bucket_of

CHUNK_SECONDS = 3600


def rising_edges(
    df: DataFrame,
    active: Column,
    *,
    key: Sequence[str],
    at: str,
    then: Sequence[str] = (),
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Rows where ``active`` holds and the same key's previous row exists and was inactive.

    One window over a whole key would put a busy device into one task. The first window
    runs per key and time chunk and settles every row but the chunk's first. The second
    sees only chunk ends (two rows per chunk at most) and carries the state across
    chunks. Rows of one instant go by ``then``, NULL first; settled edges pass through it under their own chunk number.
    """
    key, order = list(key), [at, *then]
    cols = df.columns
    chunked = df.withColumn("_on", F.coalesce(active, F.lit(False))).withColumn(
        "_chunk", bucket_of(F.col(at), chunk_seconds * MICROS)
    )
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    seen = chunked.select(
        "*", F.lag("_on").over(inside).alias("_prev"), F.lead("_on").over(inside).isNull().alias("_last")
    )
    first = F.col("_prev").isNull()
    kept = seen.where(F.col("_last") | (F.col("_on") & (first | ~F.col("_prev"))))
    lane = F.when(first | F.col("_last"), F.lit(None).cast("bigint")).otherwise(F.col("_chunk"))
    across = Window.partitionBy(*key, "_lane").orderBy(*order)
    carried = kept.withColumn("_lane", lane).withColumn("_carry", F.lag("_on").over(across))
    before = F.when(first, F.col("_carry")).otherwise(F.col("_prev"))
    return carried.where(F.col("_on") & (before == F.lit(False))).select(*cols)
