"""Merkle manifest of a dataset, stored in blocks of van Emde Boas layout.

Rows of a group (a language) are leaves in the order of their id; every 8
neighbours become one node, until one is left, the group's subroot. Subroots, in
the order of the groups, become the root in the same way.

A block is an aligned subtree of ``height`` levels above its leaves, kept as one
array of digests: the tree is cut at half its height, the upper part comes
first, then the lower subtrees from left to right, each laid out alike. So the
nodes on a way up lie in few stretches at any size of cache line or page, and a
place is found by arithmetic alone. Block roots are the leaves of the next layer
of blocks. A task holds one block; what lies above comes to it as a path.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import materialize

BITS = 3
ARITY = 1 << BITS
#: Levels of a block above its leaves: 4096 leaves.
HEIGHT = 4
DIGEST = 32

BLOCK = "tree string, block bigint, alone boolean, n bigint, nodes binary, ids array<bigint>, changed array<binary>"
PATH = "array<struct<left:string,right:string>>"


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return ((1 << BITS * levels) - 1) // (ARITY - 1)


def places(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a ``depth`` (0: root) lie in the layout of a tree of ``levels`` levels."""
    base = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
        else:
            depth, levels = depth - upper, levels - upper
            base += size(upper) + (index >> BITS * depth) * size(levels)
            index = index & ((1 << BITS * depth) - 1)
    return base


@lru_cache(maxsize=32)
def _level(levels: int, depth: int) -> tuple[int, ...]:
    return tuple(places(levels, depth, np.arange(1 << BITS * depth)).tolist())


def levels_of(n: int, alone: bool, height: int) -> int:
    """Levels of a block of ``n`` leaves: one that is its group's only one ends at its first single node."""
    levels = 1
    while levels <= height and not (alone and n == 1):
        n, levels = -(-n // ARITY), levels + 1
    return levels


def node_hash(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Block:
    """One block's digests, as hexadecimal text, by place."""

    def __init__(self, n: int, alone: bool, height: int = HEIGHT) -> None:
        self.levels = levels_of(n, alone, height)
        self.counts = [n]  # from the leaves up
        for _ in range(self.levels - 1):
            self.counts.append(-(-self.counts[-1] // ARITY))
        self.nodes = [""] * size(self.levels)

    def at(self, height: int) -> tuple[int, ...]:
        """Places of the nodes ``height`` levels above the leaves."""
        return _level(self.levels, self.levels - 1 - height)

    @classmethod
    def build(cls, leaves: list[str], alone: bool, height: int = HEIGHT) -> Block:
        self = cls(len(leaves), alone, height)
        for place, digest in zip(self.at(0), leaves, strict=False):
            self.nodes[place] = digest
        for k in range(1, self.levels):
            below, here = self.at(k - 1), self.at(k)
            for i in range(self.counts[k]):
                run = below[i * ARITY : min((i + 1) * ARITY, self.counts[k - 1])]
                self.nodes[here[i]] = node_hash([self.nodes[p] for p in run])
        return self

    @classmethod
    def load(cls, n: int, alone: bool, nodes: bytes, height: int = HEIGHT) -> Block:
        self = cls(n, alone, height)
        text = nodes.hex()
        step, none = 2 * DIGEST, "0" * 2 * DIGEST
        self.nodes = [d if (d := text[k : k + step]) != none else "" for k in range(0, len(text), step)]
        return self

    def dump(self) -> bytes:
        return bytes.fromhex("".join(d or "0" * 2 * DIGEST for d in self.nodes))

    @property
    def root(self) -> str:
        return self.nodes[0]

    def paths(self, above: list[dict]) -> Iterator[list[dict]]:
        """For each leaf the siblings on its left and right, level by level, and then ``above``."""
        known: list[list[dict]] = [above]
        for height in range(self.levels - 2, -1, -1):
            at, n = self.at(height), self.counts[height]
            known = [
                [
                    {
                        "left": "".join(self.nodes[p] for p in at[i & -ARITY : i]),
                        "right": "".join(self.nodes[p] for p in at[i + 1 : min((i & -ARITY) + ARITY, n)]),
                    },
                    *known[i >> BITS],
                ]
                for i in range(n)
            ]
        return iter(known)


def fold(digest: str, path: list[dict]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        digest = sha256((step["left"] + digest + step["right"]).encode()).hexdigest()
    return digest


def path_hash(path: list[dict]) -> str:
    """Digest of all siblings of a path, from left to right and from below."""
    return sha256("".join(s["left"] + s["right"] for s in path).encode()).hexdigest()


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``rank``, the place from 0 in each ``tree``, by ``order``.

    Rows are dealt by ranges of (tree, order) and counted where they lie; one row
    per range and tree says how many lie before. Equal rows may change places,
    and are dealt apart by a salt.
    """
    salted = nodes.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["tree", *order, "_salt"]
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(parts, ["tree", "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def build_blocks(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Rows of BLOCK from (``tree``, ``rank``, ``digest``, ``doc_id``, ``changed``); ranks of a tree have no gap."""
    width = BITS * height
    sizes = nodes.groupBy("tree").agg(F.max("rank").alias("last"))
    dealt = nodes.withColumn("block", F.shiftright("rank", width)).join(sizes, "tree").withColumn("alone", F.col("last") < (1 << width)).drop("last")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        alone = table.column("alone")[0].as_py()
        block = Block.build([d.hex() for d in table.column("digest").to_pylist()], alone, height)
        first = table.slice(0, 1)
        return pa.table(
            [
                first.column("tree"),
                first.column("block"),
                first.column("alone"),
                pa.array([table.num_rows], pa.int64()),
                pa.array([block.dump()], pa.binary()),
                pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([table.column("changed").to_pylist()], pa.list_(pa.binary())),
            ],
            names=[c.split()[0] for c in BLOCK.split(", ")],
        )

    return dealt.groupBy("tree", "block").applyInArrow(build, BLOCK)


def build_layers(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Layers of blocks, the roots of one the leaves of the next, until every tree has one block."""
    layers = []
    while True:
        layers.append(materialize(build_blocks(nodes, height), "blocks"))
        rest = layers[-1].where(~F.col("alone"))
        if rest.isEmpty():
            return layers
        none = F.lit(None)
        nodes = rest.select(
            "tree",
            F.col("block").alias("rank"),
            F.substring("nodes", 1, DIGEST).alias("digest"),
            none.cast("bigint").alias("doc_id"),
            none.cast("binary").alias("changed"),
        )


def tree_roots(layers: list[DataFrame]) -> DataFrame:
    """``tree``, ``digest``: the single node of every tree."""
    found = [b.where("alone").select("tree", F.substring("nodes", 1, DIGEST).alias("digest")) for b in layers]
    return _all(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def descend(layers: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest layer's blocks with the ``path`` from their root up; ``above`` has ``tree``, ``path`` of every tree's root."""
    found: DataFrame | None = None
    for depth in range(len(layers) - 1, -1, -1):
        blocks = layers[depth]
        mine = blocks.where("alone").select("tree", "block").join(above, "tree")
        if found is not None:
            mine = mine.unionByName(found)
        joined = blocks.join(mine, ["tree", "block"])
        if depth == 0:
            return joined

        def pass_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    first = r["block"] << BITS * height
                    paths = list(Block.load(r["n"], r["alone"], r["nodes"], height).paths(r["path"]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["tree"]] * len(paths), pa.string()),
                            pa.array(range(first, first + len(paths)), pa.int64()),
                            pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                        ],
                        ["tree", "block", "path"],
                    )

        down = joined.select("tree", "block", "alone", "n", "nodes", "path")
        found = materialize(down.mapInArrow(pass_down, f"tree string, block bigint, path {PATH}"), "paths")
    raise AssertionError("no layer")


class Manifest:
    """A dataset's tree: ``leaves`` has ``tree`` (order of groups), ``doc_id``, ``digest``, ``changed`` (another digest to verify, or null)."""

    def __init__(self, leaves: DataFrame, height: int = HEIGHT) -> None:
        self._height = height
        self.layers = build_layers(ranked(leaves, "doc_id", "digest"), height)
        roots = materialize(tree_roots(self.layers), "subroots")
        none = F.lit(None)
        named = materialize(
            ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest")), "name"), "ranked-roots"
        )
        self.subroots = roots
        self._names = named.select("name", "rank")
        self._forest = build_layers(
            named.select("tree", "rank", "digest", none.cast("bigint").alias("doc_id"), none.cast("binary").alias("changed")), height
        )
        top = tree_roots(self._forest).first()
        #: Hexadecimal, or None for a dataset without rows.
        self.root: str | None = top["digest"].hex() if top else None

    def _tree_paths(self) -> DataFrame:
        """``tree``, ``path``: from every subroot to the root."""
        spark, height = self.subroots.sparkSession, self._height
        nothing = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
        blocks = descend(self._forest, nothing, height)

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    first = r["block"] << BITS * height
                    paths = list(Block.load(r["n"], r["alone"], r["nodes"], height).paths(r["path"]))
                    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, kind)], ["rank", "path"])

        found = blocks.select("block", "alone", "n", "nodes", "path").mapInArrow(give, f"rank bigint, path {PATH}")
        return found.join(self._names, "rank").select(F.col("name").alias("tree"), "path")

    def verified(self) -> DataFrame:
        """Per leaf: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (of the changed digest, where there is one), ``verified``."""
        height, root, names = self._height, self.root, "doc_id leaf subroot root proof_sha256 folded_root verified".split()

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    block = Block.load(r["n"], r["alone"], r["nodes"], height)
                    leaves = [block.nodes[p] for p in block.at(0)[: r["n"]]]
                    proofs, folded = [], []
                    for leaf, changed, path in zip(leaves, r["changed"], block.paths(r["path"]), strict=True):
                        proofs.append(path_hash(path))
                        folded.append(fold(changed.hex() if changed is not None else leaf, path))
                    n = r["n"]
                    columns = [leaves, [r["digest"].hex()] * n, [root] * n, proofs, folded]
                    arrays = [pa.array(r["ids"], pa.int64()), *[pa.array(c, pa.string()) for c in columns], pa.array([f == root for f in folded])]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        above = materialize(self._tree_paths(), "tree-paths")
        rows = descend(self.layers, above, height).join(self.subroots, "tree")
        schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return rows.select("alone", "n", "nodes", "ids", "changed", "path", "digest").mapInArrow(prove, schema)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept; ``lower`` does that wherever a text is plain ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents (doc_id, source, lang, n_chars, text), a tree per language; ``changed`` for every third id by checksum."""

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256))

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),  # null first, then by bytes
        "doc_id",
        leaf(F.col("text")).alias("digest"),
        F.when(tampered, leaf(lower_ascii(F.col("text")))).alias("changed"),
    )


def manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of a documents table.

    Ids ascend with null first; rows of equal id go by their leaf, equal rows are
    leaves each. A null id is never tampered with. Null and empty values differ
    in their leaves, null and empty languages are two groups. Texts of any length
    are hashed whole where they lie. Further columns are ignored; no rows: no
    root and no proofs.
    """
    return Manifest(materialize(document_leaves(docs), "leaves"), height)
