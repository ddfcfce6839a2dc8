"""Repeated word passages by compressed FM-indexes.

A passage is a window of ``WINDOW`` words. Windows are routed by an anchor, the
smallest hash among the window's ``GRAM``-word grams: equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a document falls into
few segments (runs of windows with one anchor). A segment whose anchor occurs
nowhere else is settled. Equal segments are counted once with their multiplicity.
The different segments of one anchor go to one shard, which builds an FM-index
over them: the Burrows-Wheeler transform in a wavelet matrix of packed bits with
sampled ranks. Every segment is then streamed against its shard: backward search
from each word extends to the left while the match still occurs elsewhere, which
is the matching statistic of that word, followed up to the threshold; where it
reaches WINDOW, the window is repeated.

An anchor with very many different segments (a passage in many contexts) would
make one large shard. Its segments are cut into single windows, which are counted
by a 64-bit hash with a grouped aggregation: no index is built or searched for them.
Equal segments are settled by their 64-bit digest, without an index too.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import give_back, lean, whole_rows
from fleetlens.llm.hashing import SKETCH_BITS, SLICES, WordHashes, merged_sketch, sketch_parts, sketch_rows, sketch_slot, window_hashes
from fleetlens.session import materialize

WINDOW = 35
GRAM = 8
SPAN = WINDOW - GRAM + 1
#: An anchor counted more often than this by the sketch is spread over SALTS tasks and taken as repeated.
HOT = 4096
SALTS = 256
#: Words indexed in one shard, and different segments of an anchor from which it is cut into windows.
SHARD_WORDS = 400_000
MOST_SEGMENTS = 4000
#: Suffixes are sorted by so many words, which is enough to search for shorter patterns.
DEPTH = 64

SEGMENT = "anchor bigint, digest bigint, doc_id bigint, h bigint, start int, windows int, inner boolean, slot int, slice int, counts binary"


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``text`` as bytes."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))


def segments(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows, and whether windows may repeat inside, of each segment.

    The smallest gram of every window is found by doubling the width, with the
    place of its first occurrence. Equal windows of one segment have it at equal
    distances, so it then stands at several places.
    """
    low, place, width = window_hashes(hashes, GRAM), np.arange(len(hashes) - GRAM + 1), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        later = low[step:] < low[:-step]
        low, place = np.where(later, low[step:], low[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    inner = np.minimum.reduceat(place, starts) != np.maximum.reduceat(place, starts)
    return low[starts], starts, np.diff(np.r_[starts, len(low)]), inner


def cut_segments(docs: DataFrame) -> DataFrame:
    """All segments of all rows (see SEGMENT); ``digest`` tells the word sequences apart.

    The same pass counts the anchors: rows with a ``slice`` hold a task's part of the count sketch.
    """
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            rows: list[np.ndarray] = []
            for k, text in enumerate(b.column(2).to_pylist()):
                words = (text or b"").split()
                if len(words) < WINDOW:
                    continue
                w = hashes.of(words)
                anchor, start, windows, inner = segments(w)
                raw = w.tobytes()
                ends = start + windows + WINDOW - 1
                digest = [xxhash.xxh64_intdigest(raw[8 * i : 8 * j]) for i, j in zip(start.tolist(), ends.tolist(), strict=True)]
                rows.append(np.full(len(start), k))
                parts = (anchor, np.array(digest, np.uint64).view(np.int64), start, windows, inner)
                for column, v in zip(columns, parts, strict=True):
                    column.append(v)
            if not rows:
                continue
            sketch_parts(columns[0], total)
            anchor, digest, start, windows, inner = (np.concatenate(c) for c in columns)
            at = pa.array(np.concatenate(rows))
            arrays = [pa.array(anchor.view(np.int64)), pa.array(digest), b.column(0).take(at), b.column(1).take(at)]
            arrays += [pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(inner)]
            arrays += [pa.array(sketch_slot(anchor).astype(np.int32)), pa.nulls(len(anchor), pa.int32()), pa.nulls(len(anchor), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        kinds = (*(pa.int64(),) * 4, pa.int32(), pa.int32(), pa.bool_(), pa.int32())
        parts = [pa.array(range(SLICES), pa.int32()), pa.array(sketch_rows(total), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, k) for k in kinds] + parts, names)

    return text_rows(docs).mapInArrow(lean(run), SEGMENT)


def repeated_anchors(cut: DataFrame) -> DataFrame:
    """The segments whose anchor occurs more than once, or may; one shuffle, hot anchors spread.

    Hot anchors are known by their slots in the count sketch, which has a fixed size.
    """
    sketch = merged_sketch(cut.where("slice IS NOT NULL").select("slice", "counts"))
    crowded = [(int(k), True) for k in np.flatnonzero(sketch > HOT)]
    rows, hot = cut.where("slice IS NULL").drop("slice", "counts"), F.lit(False)
    if crowded:
        rows = rows.join(F.broadcast(cut.sparkSession.createDataFrame(crowded, "slot int, hot boolean")), "slot", "left")
        hot = F.coalesce("hot", F.lit(False))
    salted = rows.withColumn("hot", hot).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "h", "start"), F.lit(SALTS))).otherwise(0))
    n = F.count("*").over(Window.partitionBy("anchor", "salt"))
    return salted.withColumn("n", n).where(F.col("hot") | F.col("inner") | (F.col("n") > 1)).drop("salt", "n", "hot", "slot")


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level of packed bits per binary digit, ranks sampled every 64."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        n = len(sequence)
        current = sequence
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (current >> shift & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
            zeros = n - int(bits.sum())
            self.levels.append((shift, words, before, zeros))
            current = np.r_[current[~bits], current[bits]]
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, words, before, zeros in self.levels:
            block = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(words[block] & mask)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._walk(symbol, i) - self.base[symbol]


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first DEPTH symbols, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        k *= 2
        if k >= DEPTH or k >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Segments (word numbers from 1, each with a multiplicity) ready for backward search."""

    def __init__(self, parts: list[np.ndarray], multiplicity: np.ndarray) -> None:
        gap = np.zeros(1, np.int64)
        self.text = np.concatenate([x for p in parts for x in (gap, p)] + [gap])
        self.starts = 1 + np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        order = sorted_suffixes(self.text)
        symbols = int(self.text.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(self.text, minlength=symbols))]
        self.ranks = WaveletMatrix(self.text[order - 1], symbols)
        weight = np.zeros(len(self.text), np.int64)
        for s, p, m in zip(self.starts.tolist(), parts, multiplicity.tolist(), strict=True):
            weight[s : s + len(p)] = m
        self.weight = np.r_[0, np.cumsum(weight[order])]

    def matching_statistics(self, ends: np.ndarray, limit: int) -> np.ndarray:
        """Length, up to ``limit``, of the longest match that ends at each text position and occurs twice or more."""
        length = np.zeros(len(ends), np.int64)
        live, low, high = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text))
        for step in range(limit):
            symbol = self.text[ends[live] - step]
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
            more = (symbol > 0) & (self.weight[high] - self.weight[low] > 1)
            live, low, high = live[more], low[more], high[more]
            length[live] += 1
            if not len(live):
                break
        return length


def runs_of(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and lengths of the runs of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()


RUNS = "anchor bigint, digest bigint, froms array<int>, counts array<int>"


def search_shards(pieces: DataFrame) -> DataFrame:
    """Runs of repeated windows of each segment; ``pieces``: shard, anchor, digest, copies, words."""

    def search(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        parts = [
            np.fromiter((number.setdefault(w, len(number) + 1) for w in words.split()), np.int64)
            for words in table.column("words").to_pylist()
        ]
        copies = table.column("copies").to_numpy()
        index = FMIndex(parts, copies)
        froms, counts = [], []
        open_ = np.flatnonzero(copies == 1)
        ends = [index.starts[k] + np.arange(WINDOW - 1, len(parts[k])) for k in open_]
        found = [index.matching_statistics(np.concatenate(ends[i : i + 2000]), WINDOW) for i in range(0, len(ends), 2000)]
        flat, at = (np.concatenate(found) if found else np.empty(0, np.int64)) >= WINDOW, 0
        for k, p in enumerate(parts):
            n = len(p) - WINDOW + 1
            if copies[k] > 1:  # every window of it occurs in its copies
                f, c = [0], [n]
            else:
                f, c = runs_of(flat[at : at + n])
                at += n
            froms.append(f)
            counts.append(c)
        kinds = pa.list_(pa.int32())
        arrays = [table.column("anchor"), table.column("digest"), pa.array(froms, kinds), pa.array(counts, kinds)]
        del index, found, ends, parts, number
        give_back()
        return pa.table(arrays, names=["anchor", "digest", "froms", "counts"])

    return pieces.groupBy("shard").applyInArrow(search, RUNS).where(F.size("froms") > 0)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` segments (anchor, digest, copies, windows, row: doc_id, h, start) with their words, from the texts."""
    lists = wanted.groupBy("row.doc_id", "row.h").agg(
        F.collect_list(F.struct("anchor", "digest", "copies", F.col("row.start").alias("start"), "windows")).alias("list")
    )
    found = text_rows(docs).alias("d").join(lists.alias("l"), F.expr("d.doc_id <=> l.doc_id AND d.h = l.h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()
                for i in items:
                    part = words[i["start"] : i["start"] + i["windows"] + WINDOW - 1]
                    for column, v in zip(out, (i["anchor"], i["digest"], i["copies"], b" ".join(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "digest", "copies", "words"])

    schema = "anchor bigint, digest bigint, copies bigint, words binary"
    # equal rows of a table fetch the same segment again
    return found.select("text", "list").mapInArrow(lean(run), schema).dropDuplicates(["anchor", "digest"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, ``first``, ``windows``: runs of windows whose words also start elsewhere."""
    cut = materialize(cut_segments(docs), "cut")
    seen = materialize(repeated_anchors(cut), "segments")
    different = seen.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.max("inner").alias("inner"), F.max("windows").alias("windows"),
        F.min(F.struct("doc_id", "h", "start")).alias("row"),
    )
    different = materialize(different, "different-segments")
    anchors = different.groupBy("anchor").agg(F.count("*").alias("n_segments"), F.max("inner").alias("any_inner"))
    judged = different.join(anchors, "anchor")
    alone = judged.where((F.col("n_segments") == 1) & ~F.col("any_inner"))
    copied = alone.where("copies > 1").select(
        "anchor", "digest", F.array(F.lit(0)).alias("froms"), F.array(F.col("windows")).alias("counts")
    )
    open_ = judged.where((F.col("n_segments") > 1) | F.col("any_inner"))
    pieces = materialize(_fetch(docs, open_.select("anchor", "digest", "copies", "windows", "row")), "pieces")
    pieces = pieces.join(anchors, "anchor")
    few = pieces.where(F.col("n_segments") <= MOST_SEGMENTS)
    total = few.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-total // (6 * SHARD_WORDS)))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    found = search_shards(few.select(shard, "anchor", "digest", "copies", "words"))
    crowded = _crowded(pieces.where(F.col("n_segments") > MOST_SEGMENTS))
    runs = materialize(found.unionByName(crowded).unionByName(copied), "runs")
    every = seen.join(runs, ["anchor", "digest"]).select(
        "doc_id", "h", "start", F.explode(F.arrays_zip("froms", "counts")).alias("run")
    )
    return every.select("doc_id", "h", (F.col("start") + F.col("run.froms")).alias("first"), F.col("run.counts").alias("windows"))


def _crowded(pieces: DataFrame) -> DataFrame:
    """Runs of crowded anchors' segments: their windows are counted by a 64-bit hash, without an index."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            anchors, digests, copies, texts = (b.column(k).to_pylist() for k in range(4))
            out: list[list] = [[], [], [], [], []]
            for a, d, c, words in zip(anchors, digests, copies, texts, strict=True):
                own = window_hashes(hashes.of(words.split()), WINDOW).view(np.int64).tolist()
                for column, v in zip(out, ([a] * len(own), [d] * len(own), [c] * len(own), range(len(own)), own), strict=True):
                    column += v
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(),) * 3 + (pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "digest", "copies", "at", "window"])

    schema = "anchor bigint, digest bigint, copies bigint, at int, window bigint"
    single = pieces.select("anchor", "digest", "copies", "words").mapInArrow(lean(cut), schema)
    often = single.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    hits = single.join(often, "window").groupBy("anchor", "digest").agg(F.sort_array(F.collect_set("at")).alias("froms"))
    return hits.select("anchor", "digest", "froms", F.transform("froms", lambda _: F.lit(1)).alias("counts"))


def removal(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, h, text as bytes) with ``spans``: their runs of repeated windows, null if there are none."""
    spans = repeated_windows(docs.select("doc_id", "text")).groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("first", "windows")).alias("spans")
    )
    return text_rows(docs).alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.h = s.h"), "left").select(
        "d.doc_id", "d.h", "text", "spans"
    )


def kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words that no repeated window covers."""
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["first"]] += 1
        edge[s["first"] + s["windows"] + WINDOW - 1] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``.

    Every occurrence of a repeated window goes, the first one too, judged on the
    input. Texts with fewer than WINDOW words, null and empty ones lose nothing.
    Equal rows are each other's repetition; null ids are ids like others; an
    empty table gives none; columns beyond doc_id and text are ignored. Words
    and windows are compared by 64-bit hashes before the index compares words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, digests = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                kept = kept_words(words, spans)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(sha256(b" ".join(kept)).hexdigest())
            arrays = [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return removal(docs).select("doc_id", "text", "spans").mapInArrow(lean(run), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words, one space between, as text where something is removed; n_chars follows if there."""

    @F.pandas_udf("string")
    def rest(texts, spans):  # noqa: ANN001, ANN202
        return texts.combine(spans, lambda t, s: b" ".join(kept_words(t.split(), list(s))).decode())

    spans = repeated_windows(docs.select("doc_id", "text")).groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("first", "windows")).alias("spans")
    )
    keyed = whole_rows(docs, doc_id="doc_id", h=F.xxhash64("text"))
    joined = keyed.alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.h = s.h"), "left")
    touched = F.col("spans").isNotNull()
    same = joined.where(~touched).select("row.*")
    cut = joined.where(touched).select("row", rest(F.col("row.text").cast("binary"), F.col("spans")).alias("rest"))
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return same.unionByName(cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
