"""Device identity: ``node#index`` in tables, ``node-index`` in raw headers and cards."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RAW = r"^(.+)-([0-9]+)$"
# Fixed value: how pod-named devices begin.
POD_PREFIX = "lingjun"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def raw_node(raw: str | Column) -> Column:
    """Node part of ``<node>-<index>`` (split on the last dash); malformed names fail."""
    return F.when(_c(raw).rlike(_RAW), F.regexp_extract(_c(raw), _RAW, 1)).otherwise(
        F.raise_error(F.concat(F.lit("unrecognized device id: "), F.coalesce(_c(raw), F.lit("<null>"))))
    )


def raw_index(raw: str | Column) -> Column:
    return F.when(_c(raw).rlike(_RAW), F.regexp_extract(_c(raw), _RAW, 2).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unrecognized device id: "), F.coalesce(_c(raw), F.lit("<null>"))))
    )


def canonical(node: str | Column, index: str | Column) -> Column:
    return F.concat_ws("#", _c(node), _c(index).cast("string"))


def node_of(gpu: str | Column) -> Column:
    return F.substring_index(_c(gpu), "#", 1)


def index_of(gpu: str | Column) -> Column:
    return F.substring_index(_c(gpu), "#", -1).cast("int")


def dash_id(gpu: str | Column) -> Column:
    return F.concat_ws("-", node_of(gpu), F.substring_index(_c(gpu), "#", -1))


def fold_alias(df: DataFrame, alias: DataFrame, node: str = "node") -> DataFrame:
    """Rewrite foreign node names through ``alias(foreign, node)``; unknown names stay."""
    table = alias.select(F.col("foreign").alias("_foreign"), F.col("node").alias("_known"))
    return (
        df.join(table, F.col(node) == F.col("_foreign"), "left")
        .withColumn(node, F.coalesce("_known", node))
        .drop("_foreign", "_known")
    )


def is_ip_named(gpu: str | Column) -> Column:
    return _c(gpu).rlike("^[0-9]")


def is_pod_named(gpu: str | Column) -> Column:
    return _c(gpu).startswith(POD_PREFIX)


def ip_sort_key(node: str | Column) -> Column:
    """Dotted name with every part padded to three characters, for a numeric order."""
    return F.array_join(F.transform(F.split(_c(node), r"\."), lambda p: F.lpad(p, 3, "0")), ".")


def parse_header_name(raw: str, alias: Mapping[str, str] | None = None) -> tuple[str, int]:
    """One header cell on the driver, same rule as :func:`raw_node`."""
    match = re.match(_RAW, raw)
    if not match:
        raise ValueError(f"unrecognized device id (need '<node>-<index>'): {raw!r}")
    node = match.group(1)
    return (alias or {}).get(node, node), int(match.group(2))
