"""Language-model scores of whole texts by context-tree weighting, beside a unigram base.

A text is modelled as its lower-cased words (A-Z only), a space after each, and
a line end at last. Counts and scores travel by block, some 32 MB of text:

1. One pass over the documents counts, per block, every distinct key (context
   and next byte) and word, and writes the block's words compressed. Each block
   names all keys that it will ask for, those met only in held-out texts too.
2. Keys go to shards by their three nearest context bytes. Shards add the counts
   of about FAN blocks at a time until one row per shard is left, so no task
   gathers what all blocks sent.
3. Shards settle their subtrees; the levels above are grouped sums. Depth 1 has
   at most 256 contexts of 255 nodes and so is the only one that is collected
   and broadcast.
4. A shard's answers go back to the blocks that asked, FAN of them at a time,
   and meet the block's texts, which are scored as a stream.

Words take the same way under their 64-bit hash. The model is not capped: it
holds every key and word of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.context_tree import TOP, Mix, Nodes, Subtrees, context_keys, grouped, lift, mix_down
from fleetlens.llm.hashing import WordHashes
from fleetlens.session import materialize

#: Context bytes of the deepest nodes; a key holds one more byte.
DEPTH = 6
SHARDS = 512
#: Text bytes of a block, and of what is sorted or compressed at once.
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20
#: Blocks (or sums of blocks) that meet in one task.
FAN = 1024
END = b"\n"
CONTEXTS, WORDS = 0, 1

_ONE = np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block bigint, kind int, shard int, keys binary, counts binary, texts binary, ids binary, flags binary"


def pack_numbers(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers compressed, equal bytes of all side by side; ascending ones (64-bit) as differences."""
    if ascending:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack_numbers(packed: bytes, kind: type = np.int64, ascending: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    values = np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending else values


def unpack_keys(packed: bytes) -> np.ndarray:
    return unpack_numbers(packed, np.uint64, True)


#: What the model says of a key: the log10 probability of a context's byte, or the count of a word.
VALUE = {CONTEXTS: np.float32, WORDS: np.int64}


def normal(text: str | None) -> bytes:
    """The lower-cased words of a text with one space between."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def words_of(line: bytes) -> list[bytes]:
    """Tokens of a normal text: its words and the end."""
    return [*line.split(b" "), END] if line else [END]


def text_keys(lines: Iterable[bytes], depth: int, chunk_bytes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, keys) of normal texts, in slices of bounded size; a text starts without context."""
    for k, line in enumerate(lines):
        stream = np.frombuffer(bytes(depth) + line + (b" " if line else b"") + END, np.uint8)
        for at in range(0, len(stream) - depth, chunk_bytes):
            yield k, context_keys(stream[at : at + chunk_bytes + depth], depth)


def shard_of(kind: int, keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """Contexts go by their TOP + 1 nearest bytes, so that a shard holds whole subtrees; words by their hash."""
    head = keys >> np.uint64(8 * (depth - TOP)) if kind == CONTEXTS else keys
    return ((head * _SPREAD) >> np.uint64(32)) % np.uint64(shards)


class Counter:
    """Distinct keys of a block with their count in training texts (0: only in others)."""

    def __init__(self, chunk: int) -> None:
        self.chunk = chunk
        self.waiting: list[np.ndarray] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        # the low bit says whether the key counts
        self.waiting.append(keys << _ONE | np.uint64(train))
        self.size += len(keys)
        if self.size >= self.chunk:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            marked, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.counted.append((marked >> _ONE, np.where(marked & _ONE == 1, n, 0)))
            self.waiting, self.size = [], 0
            if sum(len(k) for k, _ in self.counted[1:]) > len(self.counted[0][0]) + self.chunk:
                self.counted = [merged(self.counted)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        return merged(self.counted)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts, _ = grouped(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return keys, counts


def word_keys(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """63-bit hashes of words: the low bit of a counted key is taken."""
    return hashes.of(words) >> _ONE


def count_blocks(docs: DataFrame, depth: int, shards: int, block_bytes: int, chunk_bytes: int) -> DataFrame:
    """Rows of BLOCKS: per block and shard its keys and counts, and chunks of its texts; ``docs`` has doc_id, text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, task, number = WordHashes(), TaskContext.get().partitionId(), 0
        counters, held, held_bytes, in_block = (Counter(chunk_bytes), Counter(chunk_bytes)), [], 0, 0
        kinds = dict(zip("block kind shard keys counts texts ids flags".split(), [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5], strict=True))

        def row(**given) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            given["block"] = [task << 32 | number] * n
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

        def texts() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(b"\n".join(line for _, line, _ in held))
            ids = np.array([i or 0 for i, _, _ in held], np.int64).tobytes()
            flags = bytes((i is None) << 1 | bool(h) for i, _, h in held)
            return row(texts=[packed], ids=[ids], flags=[flags])

        def block() -> Iterator[pa.RecordBatch]:
            for kind, counter in zip((CONTEXTS, WORDS), counters, strict=True):
                keys, counts = counter.result()
                to = shard_of(kind, keys, depth, shards)
                order = np.argsort(to, kind="stable")
                found, at = np.unique(to[order], return_index=True)
                pieces = [order[a:b] for a, b in zip(at, [*at[1:], len(order)], strict=True)]
                yield row(
                    kind=[kind] * len(pieces),
                    shard=found.astype(np.int32),
                    keys=[pack_numbers(keys[p], True) for p in pieces],
                    counts=[pack_numbers(counts[p]) for p in pieces],
                )

        for b in batches:
            for doc_id, text, held_out in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = normal(text)
                for _, keys in text_keys([line], depth, chunk_bytes):
                    counters[CONTEXTS].add(keys, not held_out)
                counters[WORDS].add(word_keys(words_of(line), hashes), not held_out)
                held.append((doc_id, line, held_out))
                held_bytes += len(line) + 1
                if held_bytes >= chunk_bytes:
                    yield texts()
                    in_block, held, held_bytes = in_block + held_bytes, [], 0
                    if in_block >= block_bytes:
                        yield from block()
                        counters, in_block, number = (Counter(chunk_bytes), Counter(chunk_bytes)), 0, number + 1
        if held:
            yield texts()
        if held or in_block:
            yield from block()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, BLOCKS)


def merge_counts(blobs: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """One row (``kind``, ``shard``, ``keys``, ``counts``) per shard, from rows per block; at most about ``fan`` meet at once."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merged([(unpack_keys(r["keys"]), unpack_numbers(r["counts"])) for r in table.to_pylist()])
        columns = [[key[0].as_py()], [key[1].as_py()], [pack_numbers(keys, True)], [pack_numbers(counts)], [key[2].as_py()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "shard", "keys", "counts", "block"])

    schema = "kind int, shard int, keys binary, counts binary, block bigint"
    rows, groups = blobs.select("kind", "shard", "keys", "counts", "block"), blocks
    while True:
        groups = max(1, -(-groups // fan))
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
        rows = materialize(dealt.groupBy("kind", "shard", "group").applyInArrow(add, schema), "counts")
        if groups <= 1:
            return rows.drop("block")


def _nodes(b: pa.RecordBatch) -> Nodes:
    node, zeros, ones, below = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    return Nodes(node.view(np.uint64), zeros, ones, below)


def upper_levels(counts: DataFrame, depth: int) -> DataFrame:
    """``shard``, ``node``, ``final``, ``taken``, ``left``: the mix at depth TOP for the contexts of each shard."""
    spark = counts.sparkSession

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                trees = Subtrees(unpack_keys(r["keys"]), unpack_numbers(r["counts"]), depth, TOP + 1)
                up, _ = lift(trees.levels[-1], depth, TOP)
                shard = np.full(len(up.key), r["shard"], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (shard, up.key.view(np.int64), up.zeros, up.ones, up.below)], ["shard", "node", "zeros", "ones", "below"]
                )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            up, _ = lift(_nodes(b), depth, TOP - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (up.key.view(np.int64), up.zeros, up.ones, up.below)], ["node", "zeros", "ones", "below"]
            )

    node = "node bigint, zeros bigint, ones bigint, below double"
    add = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    rows = counts.where(F.col("kind") == CONTEXTS).select("shard", "keys", "counts")
    parts = materialize(rows.mapInArrow(settle, f"shard int, {node}"), "upper-parts")
    second = materialize(parts.groupBy("node").agg(*add), "upper")
    # at most 256 contexts of 255 nodes
    first = second.mapInArrow(weigh, node).groupBy("node").agg(*add).toPandas().sort_values("node", key=lambda k: k.astype("uint64"))
    nodes = Nodes(*(first[c].to_numpy(t) for c, t in (("node", np.uint64), ("zeros", np.int64), ("ones", np.int64), ("below", float))))
    root, to = lift(nodes, depth, 0)
    mix = mix_down(nodes, to, mix_down(root, None, None, False), False)
    known = spark.sparkContext.broadcast((nodes.key, mix.final, mix.taken, mix.left))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, *above = known.value
        for b in batches:
            here = _nodes(b)
            _, to = lift(here, depth, TOP - 1)
            parents, _ = lift(here, depth, TOP - 1)
            mix = mix_down(here, np.searchsorted(key, parents.key)[to], Mix(*above), False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (here.key.view(np.int64), mix.final, mix.taken, mix.left)], ["node", "final", "taken", "left"]
            )

    mixed = second.mapInArrow(predict, "node bigint, final double, taken double, left double")
    return parts.select("shard", "node").join(mixed, "node")


def fitted(counts: DataFrame, depth: int) -> DataFrame:
    """``kind``, ``shard``, ``keys``, ``values``: log10 probabilities of contexts' bytes (32-bit), counts of words."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        trees = Subtrees(unpack_keys(r["keys"]), unpack_numbers(r["counts"]), depth, TOP + 1)
        _, to = lift(trees.levels[-1], depth, TOP)
        node = right.column("node").to_numpy().view(np.uint64)
        order = np.argsort(node)
        above = Mix(*(right.column(c).to_numpy()[order] for c in ("final", "taken", "left")))
        mix = mix_down(trees.levels[-1], to, above, depth == TOP + 1)
        values = trees.log_probabilities(mix).astype(np.float32)
        return pa.table(
            [pa.array([CONTEXTS], pa.int32()), left.column("shard"), left.column("keys"), pa.array([pack_numbers(values)], pa.binary())],
            names=["kind", "shard", "keys", "values"],
        )

    contexts = counts.where(F.col("kind") == CONTEXTS).groupBy("shard")
    trees = contexts.cogroup(upper_levels(counts, depth).groupBy("shard")).applyInArrow(
        answer, "kind int, shard int, keys binary, values binary"
    )
    words = counts.where(F.col("kind") == WORDS).select("kind", "shard", "keys", F.col("counts").alias("values"))
    return trees.unionByName(words)


def answers(asked: DataFrame, model: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """``block``, ``kind``, ``keys``, ``values``: what the model says to the keys that each block asked for."""

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["block", "kind", "keys"]).append_column("values", pa.nulls(0, pa.binary()))
        r = right.to_pylist()[0]
        known, values = unpack_keys(r["keys"]), unpack_numbers(r["values"], VALUE[r["kind"]])
        found = [pack_numbers(values[np.searchsorted(known, unpack_keys(k))]) for k in left.column("keys").to_pylist()]
        return left.select(["block", "kind", "keys"]).append_column("values", pa.array(found, pa.binary()))

    groups = max(1, -(-blocks // fan))
    dealt = asked.select("block", "kind", "shard", "keys", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"))
    spread = model.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    by = ("kind", "shard", "group")
    return dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(tell, "block bigint, kind int, keys binary, values binary")


class Lookup:
    """A hash table from 64-bit keys to places, probed for whole arrays at once; every probed key must be in it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            empty = self.place[slot] < 0
            self.place[slot[empty]] = rest[empty]  # of several the last one gets the slot
            lost = self.place[slot] != rest
            slot, rest = (slot[lost] + 1) & self.mask, rest[lost]
        self.held = np.where(self.place >= 0, keys[self.place], ~keys[:1])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * _SPREAD >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        wrong = np.flatnonzero(self.held[slot] != keys)
        while len(wrong):
            if (self.place[slot[wrong]] < 0).any():
                raise KeyError("a key that the block did not ask for")
            slot[wrong] = (slot[wrong] + 1) & self.mask
            wrong = wrong[self.held[slot[wrong]] != keys[wrong]]
        return self.place[slot]


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, base double, score double"


def score_texts(blocks: DataFrame, told: DataFrame, depth: int, chunk_bytes: int) -> DataFrame:
    """Rows of SCORES; ``base`` is the sum of log10 (c + 1) only."""
    names = [c.split()[0] for c in SCORES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        current, parts = None, ([], [])
        tables: list[tuple[Lookup, np.ndarray]] = []

        def ready() -> None:
            for kind in (CONTEXTS, WORDS):
                keys = np.concatenate([k for k, _ in parts[kind]])
                values = np.concatenate([v for _, v in parts[kind]])
                tables.append((Lookup(keys), values))
                parts[kind].clear()

        def score(texts: bytes, ids: bytes, flags: bytes) -> pa.RecordBatch:
            (contexts, logs), (words, counts) = tables
            lines = zstandard.ZstdDecompressor().decompress(texts).split(b"\n")
            total = np.zeros(len(lines))
            for k, keys in text_keys(lines, depth, chunk_bytes):
                total[k] += logs[contexts.places(keys)].sum(dtype=np.float64)
            split = [words_of(line) for line in lines]
            sizes = np.array([len(w) for w in split])
            seen = counts[words.places(word_keys([w for s in split for w in s], hashes))]
            starts = np.cumsum(sizes) - sizes
            flag = np.frombuffer(flags, np.uint8)
            columns = [
                pa.array(np.frombuffer(ids, np.int64), mask=(flag & 2) > 0),
                pa.array((flag & 1) > 0),
                pa.array(sizes),
                pa.array(np.add.reduceat((seen > 0).astype(np.int64), starts)),
                pa.array([len(line) + bool(line) + 1 for line in lines], pa.int64()),
                pa.array(np.add.reduceat(np.log10(seen + 1), starts)),
                pa.array(total),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for r in b.to_pylist():
                if r["block"] != current:
                    current = r["block"]
                    tables.clear()
                    for p in parts:
                        p.clear()
                if r["texts"] is None:
                    parts[r["kind"]].append((unpack_keys(r["keys"]), unpack_numbers(r["values"], VALUE[r["kind"]])))
                else:
                    if not tables:
                        ready()
                    yield score(r["texts"], r["ids"], r["flags"])

    texts = blocks.where("texts IS NOT NULL").select("block", F.lit(2).alias("kind"), "texts", "ids", "flags")
    rows = told.unionByName(texts, allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, SCORES)


def score_documents(
    docs: DataFrame,
    held_out: str | None = None,
    depth: int = DEPTH,
    shards: int = SHARDS,
    fan: int = FAN,
    block_bytes: int = BLOCK_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): scores by a model of the rows that are not held out.

    ``held_out`` is a boolean SQL expression over the columns of ``docs``; null or
    none trains on the row. Returned: doc_id, held_out, n_tokens (words and one
    end), n_known (of them met in training), train_tokens, base_score (log10 by add-one
    unigrams), score (log10 by the context tree), bits_per_byte (its code length per
    byte). A null, empty or blank text is its end alone. Without training texts
    every bit has probability one half. Null ids and repeated rows stay as they
    are; an empty table gives no rows; further columns are ignored.
    """
    if not TOP < depth < 7:  # a key and the bit that marks training fill 64 bits
        raise ValueError(f"depth must lie between {TOP + 1} and 6")
    held = F.coalesce(F.expr(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    blocks = materialize(count_blocks(rows, depth, shards, block_bytes, chunk_bytes), "blocks")
    n_blocks = blocks.where("texts IS NOT NULL").select("block").distinct().count()
    asked = blocks.where("keys IS NOT NULL")
    counts = merge_counts(asked, n_blocks, fan)
    told = answers(asked, materialize(fitted(counts, depth), "model"), n_blocks, fan)
    tokens, vocabulary = _word_totals(counts)
    scored = score_texts(blocks, told, depth, chunk_bytes)
    below = F.log10(F.lit(float(tokens + vocabulary + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * below).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _word_totals(counts: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [unpack_numbers(c) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c.sum()) for c in found], pa.int64()), pa.array([int((c > 0).sum()) for c in found], pa.int64())], ["n", "v"]
            )

    sums = counts.where(F.col("kind") == WORDS).select("counts").mapInArrow(size, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).first()
    return sums[0] or 0, sums[1] or 0
