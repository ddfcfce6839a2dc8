"""Exact similarity join on word shingles: size-banded tiles, bitmap signatures, array intersection.

Documents with the same shingle set are one class; only classes are joined.
Two sets of Jaccard likeness t have a common shingle among the first
n - ceil(t n) + 1 of each, in any order that all sets share. The order is:
rarest first by a count sketch of fixed size (an upper bound of the true count),
then by hash. A shingle some sets share this way is a bucket. Inside a bucket
sets are compared in tiles of neighbouring size bands: each has a bitmap of its
hashed shingles, the bits in which two bitmaps differ bound the overlap from
above, and only pairs that pass are intersected as sorted arrays.

A group of near copies has a number of pairs that grows with its square. So a
first round links every class with leaders of its buckets; a second one finds the
classes that have a partner left to be compared with, and a third settles all of
their pairs inside their tiles: sets come along as sorted 32-bit hashes,
pairs that bitmaps and hashes leave are joined in a union-find, and a tile gives
only the links that join two of its components, so at most one per member. These
are verified by the sets themselves; should one fail, the round is repeated with
other hashes. So every link between different components is tried, no list of
pairs is made, and the components are those of the complete join.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, lean, whole_rows
from fleetlens.llm.hashing import (
    SKETCH_BITS,
    SLICES,
    WordHashes,
    components,
    filter_slot,
    merged_sketch,
    mixed,
    row_filter,
    sketch_parts,
    sketch_rows,
    sketch_slot,
    window_hashes,
)
from fleetlens.session import materialize

SHINGLE = 5
#: Sets of n and m shingles, I of them common, are linked if 100 I >= 75 (n + m - I), that is 7 I >= 3 (n + m).
#: A shingle counted more often than this by the sketch is spread over SALTS tasks and taken as shared.
HOT = 4096
SALTS = 256
#: Bitmap widths: the power of two from the set's size on, between these.
MIN_BITS, MAX_BITS = 64, 1 << 16
#: Leaders tried for a class in the first round, and buckets that are compared by their members in the second.
LEADERS = 4
FEW = 16
#: Buckets beyond this are cut into tiles of about so many sets of SET_SIZE shingles; a larger set counts for several.
#: A tile is held by one task (about 50 MB), and each cut sends a set to more tiles.
TILE, SET_SIZE = 8192, 500
#: Bits per shingle of the last round's bitmaps, which are made where the tile is: they alone reject nearly all that is below 0.74.
WIDE = 32


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z are lower-cased, fewer than five words are one shingle."""
    words = (text or b"").lower().split()
    h = hashes.of(words)
    if 0 < len(words) < SHINGLE:
        return window_hashes(h, len(words))
    return np.unique(window_hashes(h, SHINGLE))


def bitmap(s: np.ndarray, per_shingle: int = 1) -> bytes:
    """Bits h mod width of a set; halving the width is OR-ing the halves."""
    width = min(max(MIN_BITS, per_shingle << (len(s) - 1).bit_length()), per_shingle * MAX_BITS)
    flags = np.zeros(width, bool)
    flags[(s & s.dtype.type(width - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    """n - ceil(0.75 n) + 1 for a set of n > 0 shingles."""
    return n - (3 * n + 3) // 4 + 1


DESCRIBED = "doc_id bigint, h bigint, n bigint, key bigint, bits binary, slice int, counts binary"


def describe(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``h`` (hash of the text), ``n``, ``key`` (hash of the shingle set), ``bits``.

    The same pass counts the shingles: rows with a ``slice`` hold a task's part of the count sketch.
    """
    names = [c.split()[0] for c in DESCRIBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            sets = [shingle_set(text, hashes) for text in b.column(2).to_pylist()]
            sketch_parts(sets, total)
            arrays = [
                b.column(0),
                b.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.int64()),
                pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)
        empty = [pa.nulls(SLICES, k) for k in (pa.int64(),) * 4 + (pa.binary(),)]
        parts = [pa.array(range(SLICES), pa.int32()), pa.array(sketch_rows(total), pa.binary())]
        yield pa.RecordBatch.from_arrays(empty + parts, names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), DESCRIBED)


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefixes(docs: DataFrame, sketch: Broadcast) -> DataFrame:
    """``token``, ``key``, ``n``, ``hot``: each row's first shingles in the common order; the sketch is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.frombuffer(sketch.value, np.uint16)
        for b in batches:
            tokens, keys, sizes, hot = [], [], [], []
            for text in b.column(0).to_pylist():
                s = shingle_set(text, hashes)
                if len(s):
                    often = counts[sketch_slot(s)]
                    first = np.argsort(often, kind="stable")[: prefix_size(len(s))]
                    hot.append(often[first] > HOT)
                    tokens.append(s[first])
                    keys.append(np.full(len(first), set_key(s)))
                    sizes.append(np.full(len(first), len(s)))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(keys), np.concatenate(sizes).astype(np.int32)]
                columns.append(np.concatenate(hot))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "key", "n", "hot"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(lean(run), "token bigint, key bigint, n int, hot boolean")


def shared_shingles(entries: DataFrame) -> DataFrame:
    """The entries whose shingle some other class has too, each once; one shuffle, hot shingles spread."""
    salted = entries.withColumn("salt", F.when(F.col("hot"), F.pmod("key", F.lit(SALTS))).otherwise(0))
    bucket = Window.partitionBy("token", "salt")
    by_key = bucket.orderBy("key")
    seen = salted.withColumns(
        {"before": F.lag("key").over(by_key), "low": F.min("key").over(bucket), "high": F.max("key").over(bucket)}
    )
    once = F.col("before").isNull() | (F.col("before") != F.col("key"))
    return seen.where(once & (F.col("hot") | (F.col("low") < F.col("high")))).select("token", "key", "n")


def intersects(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return 7 * int((b[at] == a).sum()) >= 3 * (len(a) + len(b))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets (``key``, ``shingles``) are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (b.column(k).to_pylist() for k in (2, 3))
            good = [intersects(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a bigint, b bigint")


def fits_by_bits(n: np.ndarray, m: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Whether sizes and differing bits still allow a link: the overlap is at most (n + m - differing) / 2."""
    return (7 * ((n + m - differing) // 2) >= 3 * (n + m)) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))


def differing_bits(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits in which a bitmap (bytes) differs from each row of another width, after folding the wider."""
    while len(one) > many.shape[1]:
        one = one[: len(one) // 2] | one[len(one) // 2 :]
    while many.shape[1] > len(one):
        many = many[:, : many.shape[1] // 2] | many[:, many.shape[1] // 2 :]
    return np.bitwise_count(many.view(np.uint64) ^ one.view(np.uint64)).sum(axis=1, dtype=np.int64)


def close_by_bits(pairs: DataFrame) -> DataFrame:
    """The rows of (a, b, na, nb, bits_a, bits_b) whose bitmaps still allow a link, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            maps = zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)
            d = [int(differing_bits(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)[None, :])[0]) for x, y in maps]
            good = fits_by_bits(na, nb, np.array(d, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(lean(run), "a bigint, b bigint")


class Tile:
    """The sets of one tile by size, with their bitmaps by width."""

    def __init__(self, key: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, bits: list[bytes]) -> None:
        self.order = np.argsort(n, kind="stable")
        self.key, self.n, self.label, self.side = key[self.order], n[self.order], label[self.order], side[self.order]
        self.width = np.array([len(bits[i]) for i in self.order])
        self.rows = {w: np.flatnonzero(self.width == w) for w in np.unique(self.width)}
        self.maps = {w: np.frombuffer(b"".join(bits[self.order[i]] for i in r), np.uint8).reshape(len(r), w) for w, r in self.rows.items()}

    def close(self, i: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Larger sets of other labels that sizes and bitmaps allow to be linked with set ``i``, and the bits they differ in.

        ``side`` 0 meets 0 and 1, 1 only meets 0.
        """
        own = self.maps[self.width[i]][np.searchsorted(self.rows[self.width[i]], i)]
        for w, r in self.rows.items():
            start, stop = np.searchsorted(r, i, "right"), np.searchsorted(self.n[r], self.n[i] * 4 // 3, "right")
            other = r[start:stop]
            open_ = (label[other] != label[i]) & ((self.side[other] + self.side[i]) < 2)
            if not open_.any():
                continue
            other, there = other[open_], self.maps[w][start:stop][open_]
            differ = differing_bits(own, there)
            good = fits_by_bits(self.n[other], self.n[i], differ)
            if good.any():
                yield other[good], differ[good]


def closest_in(tile: Tile) -> dict[tuple[int, int], int]:
    """Of each set the pair with the fewest differing bits for its size: at most one pair per set."""
    best, partner = np.full(len(tile.key), np.inf), np.full(len(tile.key), -1)
    for i in range(len(tile.key)):
        for other, differ in tile.close(i, tile.label):
            share = differ / (tile.n[other] + tile.n[i])
            nearer = share < best[other]
            best[other[nearer]], partner[other[nearer]] = share[nearer], i
            if share.min() < best[i]:
                best[i], partner[i] = share.min(), other[share.argmin()]
    found = {}
    for i in np.flatnonzero(partner >= 0).tolist():
        found[tuple(sorted((int(tile.key[i]), int(tile.key[partner[i]]))))] = int(best[i] * 1_000_000)
    return found


def links_in(tile: Tile, hashes: list[bytes]) -> dict[tuple[int, int], int]:
    """Links by 32-bit hashes that join two components of the tile; its members' labels are where they start."""
    sets = [np.frombuffer(hashes[i], np.uint32) for i in tile.order]
    # components as numbers; joining two renumbers the members of one
    _, part = np.unique(tile.label, return_inverse=True)
    found = {}
    for i in range(len(sets)):
        for other, _ in tile.close(i, part):
            inside = np.concatenate([sets[j] for j in other.tolist()])
            at = np.minimum(np.searchsorted(sets[i], inside), len(sets[i]) - 1)
            edges = np.cumsum([0] + [len(sets[j]) for j in other.tolist()])[:-1]
            both = np.add.reduceat((sets[i][at] == inside).astype(np.int64), edges)
            for j in other[7 * both >= 3 * (tile.n[other] + tile.n[i])].tolist():
                if part[j] != part[i]:
                    found[tuple(sorted((int(tile.key[i]), int(tile.key[j]))))] = 0
                    part[part == part[j]] = part[i]
    return found


def tile_links(tiles: DataFrame, exact: bool = False) -> DataFrame:
    """Pairs (``a`` < ``b``, ``apart``) of all tiles; ``tiles`` has tile columns, key, n, label, side, bits.

    Each tile's closest pairs by bits, or, if ``exact``, its links by the hashes
    that ``bits`` then holds. Either are fewer than the tile has members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def finish() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            key, n, label, side = (t.column(c).to_numpy() for c in ("key", "n", "label", "side"))
            bits = t.column("bits").to_pylist()
            if exact:
                wide = [bitmap(np.frombuffer(h, np.uint32), WIDE) for h in bits]
                found = links_in(Tile(key, n.astype(np.int64), label, side, wide), bits)
            else:
                found = closest_in(Tile(key, n.astype(np.int64), label, side, bits))
            columns = [[a for a, _ in found], [b for _, b in found], list(found.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "apart"])

        for b in batches:
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            at = 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[at]:
                    if ids[at] != current and held:
                        yield finish()
                    current = ids[at]
                    held.append(b.slice(at, k - at))
                    at = k
        if held:
            yield finish()

    dealt = tiles.repartition("token", "tile").sortWithinPartitions("token", "tile")
    pairs = dealt.select("token", "tile", "key", "n", "label", "side", "bits").mapInArrow(lean(run), "a bigint, b bigint, apart bigint")
    return pairs.groupBy("a", "b").agg(F.min("apart").alias("apart"))


def short_hashes(sets: DataFrame, seed: int) -> DataFrame:
    """``key``, ``bits``: the sets (``key``, ``shingles``) as sorted 32-bit hashes, others for every seed.

    Equal shingles have equal hashes, so two sets share at least as many hashes as shingles
    (of equal hashes in one set each counts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.sort((mixed(np.frombuffer(s, np.uint64) + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in out], pa.binary())], ["key", "bits"])

    return sets.select("key", "shingles").mapInArrow(lean(run), "key bigint, bits binary")


def band_of(n: Column) -> Column:
    """Sets of one band are within the size ratio of 0.75, and linked sets lie in the same or in adjacent bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4.0 / 3.0)) + F.lit(1e-9)).cast("int")


def tiles_of(rows: DataFrame) -> DataFrame:
    """Rows (token, key, n, label, bits, size of the bucket) dealt to tiles.

    A small bucket is one tile. A large one is cut by size band, each band into
    blocks: a tile meets one block with itself, with another one of its band, or
    with one of the next band, so every possible pair meets in one tile.
    """
    small = rows.where(F.col("size") <= TILE).select("token", F.lit("").alias("tile"), "key", "n", "label", F.lit(0).alias("side"), "bits")
    cut = rows.where(F.col("size") > TILE).withColumns(
        {"band": band_of(F.col("n")), "blocks": F.ceil(2 * F.col("size") / TILE).cast("int")}
    )
    cut = cut.withColumn("block", F.pmod(F.col("key"), F.col("blocks")).cast("int"))
    tile = lambda b, i, j: F.concat_ws("/", b, i, j)
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.transform(
        other,
        lambda j: F.struct(
            tile(F.col("band"), F.least(j, F.col("block")), F.greatest(j, F.col("block"))).alias("tile"),
            F.when(j < F.col("block"), 1).otherwise(0).alias("side"),
        ),
    )
    # between bands: block i of this band with block j of the next
    up = F.transform(other, lambda j: F.struct(tile(F.lit("x"), F.col("band"), F.concat_ws("/", F.col("block"), j)).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(other, lambda j: F.struct(tile(F.lit("x"), F.col("band") - 1, F.concat_ws("/", j, F.col("block"))).alias("tile"), F.lit(1).alias("side")))
    large = cut.select("token", F.explode(F.concat(own, up, down)).alias("t"), "key", "n", "label", "bits")
    return small.unionByName(large.select("token", "t.tile", "key", "n", "label", "t.side", "bits"))


def leaders_of(kept: DataFrame) -> DataFrame:
    """``a``, ``na``, ``b``, ``nb``: up to LEADERS leaders for each class, those it shares most buckets with.

    A bucket's leaders are the smallest key of each size band, and the class
    with the largest share of its first shingles in buckets: of copies of one
    text, the text that was least changed.
    """
    prefix = F.col("n") - F.expr("(3 * n + 3) div 4") + 1
    shares = kept.groupBy("key", "n").agg((F.count("*") / F.first(prefix)).alias("share")).select("key", "share")
    rows = kept.join(shares, "key").withColumn("band", band_of(F.col("n")))
    pair = F.struct("key", "n")
    heads = rows.groupBy("token", "band").agg(F.array(F.min(pair), F.max_by(pair, F.struct("share", "key"))).alias("leads"))
    met = (
        rows.join(heads, ["token", "band"])
        .select("key", "n", F.explode("leads").alias("lead"))
        .where("key <> lead.key")
        .groupBy("key", "n", "lead")
        .agg(F.count("*").alias("buckets"))
    )
    order = Window.partitionBy("key").orderBy(F.desc("buckets"), "lead")
    best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
    return best.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("lead.key").alias("b"), F.col("lead.n").alias("nb"))


def open_buckets(labelled: DataFrame) -> DataFrame:
    """``token``, ``key``, ``n``, ``label``, ``size`` of the buckets with several labels; equal small buckets are one.

    Two documents that share a passage share many buckets and no more, so small
    buckets are told apart by their members, whose hash is then the token.
    """
    several = labelled.groupBy("token").agg(
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.count("*").alias("count"),
        F.greatest(F.count("*"), F.ceil(F.sum("n") / SET_SIZE)).alias("size"),
    )
    rows = labelled.join(several.where("lo < hi").select("token", "count", "size"), "token")
    few = rows.where(F.col("count") <= FEW).groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("key", "n", "label"))).alias("members"), F.first("size").alias("size")
    )
    small = few.select("members", "size").distinct().select(F.xxhash64("members").alias("token"), F.explode("members").alias("m"), "size")
    large = rows.where(F.col("count") > FEW).select("token", "key", "n", "label", "size")
    return small.select("token", "m.key", "m.n", "m.label", "size").unionByName(large)


def link_classes(docs: DataFrame, described: DataFrame) -> DataFrame:
    """``key``, ``label``: classes that are linked with another one, and their component's smallest key."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(merged_sketch(described.where("slice IS NOT NULL").select("slice", "counts")).tobytes())
    kept = materialize(shared_shingles(prefixes(docs, sketch)), "shared-shingles")
    classes = described.where("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.first("bits").alias("bits"))
    classes = materialize(classes.join(kept.select("key").distinct(), "key"), "classes")
    bits = classes.select("key", "bits")

    # round 1: leaders
    leads = leaders_of(kept)
    with_bits = leads.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("bits_a")), "a").join(
        bits.select(F.col("key").alias("b"), F.col("bits").alias("bits_b")), "b"
    )
    close = materialize(close_by_bits(with_bits), "pairs-1")
    links = materialize(verified(close, _sets(docs, classes, close)), "links-1")

    # classes that size and bitmap still let meet one of another component
    near = materialize(tile_links(tiles_of(open_buckets(_labelled(kept, links)).join(bits, "key"))), "closest")
    keys = materialize(near.select(F.col("a").alias("key")).union(near.select("b")).distinct(), "open-keys")
    sets, kept = _sets(docs, classes, near), materialize(kept.join(keys, "key"), "open-shingles")

    # all pairs of these, tile by tile
    seed = 0
    while True:
        tiles = tiles_of(open_buckets(_labelled(kept, links)).join(short_hashes(sets, seed), "key"))
        more = materialize(tile_links(tiles, exact=True).select("a", "b"), "pairs")
        found = materialize(verified(more, sets), "links")
        links = materialize(links.unionByName(found), "links")
        if found.count() == more.count():  # what a tile left out was connected by true links
            return components(links)
        seed += 1


def _labelled(kept: DataFrame, links: DataFrame) -> DataFrame:
    labels = materialize(components(links), "labels")
    return kept.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key``, ``shingles`` of the classes in ``pairs``, from the text of one document each.

    A bit set of fixed size says which rows may be wanted, so that texts are
    read again but not shuffled; what it lets through besides is dropped by key.
    """
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = materialize(classes.join(keys, "key").select(F.xxhash64("row.doc_id", "row.h").alias("id"), "key"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(row_filter(wanted.select("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flags = WordHashes(), np.frombuffer(bits.value, np.uint8)
        for b in batches:
            slot = filter_slot(b.column(0).to_numpy())
            rows = np.flatnonzero(flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            if not len(rows):
                continue
            sets = [shingle_set(t, hashes) for t in b.column(1).take(pa.array(rows)).to_pylist()]
            arrays = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "shingles"])

    rows = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(lean(run), "key bigint, shingles binary").join(wanted.select("key"), "key", "left_semi")
    return materialize(found.dropDuplicates(["key"]), "shingle-sets")


def classify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h, n, key, label; the label is null for texts without words."""
    described = materialize(describe(docs), "described")
    labels = link_classes(docs, described)
    described = described.where("slice IS NULL").select("doc_id", "h", "n", "key")
    keys = described.where("n > 0").select("key").distinct().join(labels, "key", "left")
    known = materialize(keys.select("key", F.coalesce("label", "key").alias("label")), "labels")
    return described.join(known, "key", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links (Jaccard of
    shingle sets at least 0.75), the row's own included. Texts without words and
    null ones have no shingles and no links: their own doc_id. Ties don't
    matter, as links are symmetric; repeated rows each get a row; a null doc_id
    takes its component's smallest; an empty table gives none. Sets are told
    apart by a 64-bit hash. Columns beyond doc_id and text are ignored.
    """
    rows = materialize(classify(docs.select("doc_id", "text")), "classified")
    smallest = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(smallest, "label", "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component (null ids last); rows without words all stay."""
    rows = classify(docs.select("doc_id", "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = rows.where("n > 0").groupBy("label").agg(F.min(order).alias("first")).select("first.doc_id", "first.h").alias("f")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = whole_rows(docs, doc_id="doc_id", h=F.xxhash64("text"), worded=worded)
    kept = keyed.alias("d").where("worded").join(first, F.expr("d.doc_id <=> f.doc_id AND d.h = f.h"), "left_semi")
    return kept.dropDuplicates(["doc_id", "h"]).select("row.*").unionByName(keyed.where(~F.col("worded")).select("row.*"))
