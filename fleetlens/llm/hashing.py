"""64-bit hashes of words and word windows, and connected components over small link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize

#: Slots of the count sketch, and the parts it is merged in.
SKETCH_BITS = 22
SLICES = 64
#: Words remembered per worker before the table is emptied.
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept until the table is full."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width, np.uint64)
    factor = 1
    for k in range(width):
        factor = (factor * 6364136223846793005 + 2 * k + 2) & 0xFFFFFFFFFFFFFFFF
        total += hashes[k : k + n] * np.uint64(factor | 1)
    return mixed(total)


def components(links: DataFrame) -> DataFrame:
    """``key``, ``label``: each end of a link and the smallest key it is connected with.

    Alternates two star steps (every node hands its larger neighbours, then its
    smaller ones, to the smallest it knows) until nothing changes; every step is
    a grouped minimum and a join, and its result is written.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down)
        edges = materialize(small.where("a <> b").distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    found = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("key"), "label")
    return found.union(found.select("label", "label").distinct())


def sketch_slot(h: np.ndarray) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch_parts(hashes: list[np.ndarray], total: np.ndarray) -> None:
    """Count a batch's hashes into ``total`` (2^SKETCH_BITS slots)."""
    np.add.at(total, sketch_slot(np.concatenate(hashes)), np.uint32(1))


def sketch_rows(total: np.ndarray) -> list[bytes]:
    """A task's sketch in SLICES parts of 16-bit counts, at most 65,535."""
    return [p.tobytes() for p in np.minimum(total, 65535).astype(np.uint16).reshape(SLICES, -1)]


def merged_sketch(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches (rows ``slice``, ``counts``). It has a fixed size, so it may be collected and broadcast.

    A slot's count is at least that of each hash in it.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
        for part in table.column("counts"):
            total = np.minimum(total + np.frombuffer(part.as_buffer(), np.uint16), 65535)
        merged = pa.array([total.astype(np.uint16).tobytes()], pa.binary())
        return pa.table([table.column("slice").slice(0, 1), pa.chunked_array([merged])], names=["slice", "counts"])

    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint16)
    for r in parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint16)
    return out.reshape(-1)


#: Bits of the row filter (4 MB); more rows only let more of the others through.
FILTER_BITS = 25


def filter_slot(h: np.ndarray) -> np.ndarray:
    return (mixed(h.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def row_filter(rows: DataFrame) -> bytes:
    """A bit set of fixed size that holds the 64-bit numbers in the first column of ``rows``, and few others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            flags[filter_slot(b.column(0).to_numpy())] = True
        parts = np.packbits(flags).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "bits"]
        )

    def join(table: pa.Table) -> pa.Table:
        bits = np.zeros((1 << FILTER_BITS) // 8 // SLICES, np.uint8)
        for part in table.column("bits"):
            bits |= np.frombuffer(part.as_buffer(), np.uint8)
        return pa.table([table.column("slice").slice(0, 1), pa.chunked_array([pa.array([bits.tobytes()], pa.binary())])], names=["slice", "bits"])

    schema = "slice int, bits binary"
    found = rows.coalesce(8).mapInArrow(mark, schema).groupBy("slice").applyInArrow(join, schema).collect()
    by_slice = {r["slice"]: bytes(r["bits"]) for r in found}
    empty = bytes((1 << FILTER_BITS) // 8 // SLICES)
    return b"".join(by_slice.get(k, empty) for k in range(SLICES))
