"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Each row as one struct ``row`` beside ``columns``, so that no name of its own can clash; ``row.*`` gives it back."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns.values()]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for c, k in zip(own, columns, strict=True)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none. Splitting at one plain character is the fast way."""
    flat = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Hand a worker's free memory to the system: the same process serves the next stage, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over a task's batches, with the memory that it used given back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def byte_slices(flat: bytes, lengths: list[int]) -> list[bytes]:
    out, at = [], 0
    for n in lengths:
        out.append(flat[at : at + n])
        at += n
    return out
