"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents are cut into pieces of at most ``capacity`` tokens. A piece goes to the
open bin whose choice leaves the sum over gaps g > 0 of (open bins with gap g)^2
smallest; ties go to the smallest gap. A bin is opened only where no open one has
room, and a shard takes its pieces longest first, so bins end up nearly full.
Shards are packed independently and none holds more than SHARD_PIECES pieces;
bins that stay clearly open are packed again in other and, as far as that bound
allows, fewer shards, until that no longer saves bins.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm.bpe import WordBpe
from fleetlens.llm.common import lean, texts_of
from fleetlens.plans.scan import TIE_BITS, row_ranks
from fleetlens.session import materialize

CAPACITY = 2048
END_ID = 0
#: Most pieces packed in one task, bins with a larger share of room packed again, and shards then merged into one
#: where their open pieces fit.
SHARD_PIECES = 40_000
OPEN_SHARE = 0.02
MERGE_SHARDS = 16
#: Open bins stay as they are if packing them again saves a smaller share of them.
LEAST_GAIN = 0.001

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECE}, sequence_id bigint, offset bigint, room bigint"


class LibraryIds(WordBpe):
    """Ids by the tokenizers library; only words not met before are sent to it, many at once."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # a special token written in a text is found before anything else, so it parts words that are sent together
        self.mark, self.mark_id = next(
            (t.content, i)
            for i, t in self.tokenizer.get_added_tokens_decoder().items()
            if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)
        )

    def merge_all(self, words: list[str]) -> list[bytes]:
        # words are normalized already; a few would not survive the library's normalizing them again
        odd = [w for w in words if not w.isascii() and not (w.islower() and unicodedata.is_normalized("NFC", w))]
        if odd:
            known = dict(zip(odd, super().merge_all(odd), strict=True))
            rest = [w for w in words if w not in known]
            known.update(zip(rest, self.merge_all(rest), strict=True))
            return [known[w] for w in words]
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        out: list[bytes] = []
        texts = [self.mark.join(g) for g in groups]
        for e, group in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), groups, strict=True):
            ids = np.array(e.ids, "<u4")
            flat, edges = ids.tobytes(), [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(edges) != len(group) + 1:
                raise ValueError("a word holds the mark")
            out += [flat[4 * (a + 1) : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    """One encoder per Python worker and path; its table of words goes on from task to task."""
    return LibraryIds(path)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``) of every whole text.

    A document's ids are its text's, then ``end_id``; null text is empty, so it
    still has one piece. Only documents longer than ``capacity`` are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end = library_ids(path), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for b in batches:
            out: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), library.encode_batch(texts_of(b.column(1))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # gap 0 stays 0: full bins don't count
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        before = count[size:]  # by gap from size to capacity
        # the square sum changes by 2 (bins with the gap left + 1) - 2 bins with this gap
        change = np.where(before > 0, 2 * (count[: capacity + 1 - size] - before) + 2, far)
        change[0] -= before[0] > 0  # a full bin leaves the sum
        best = int(change.argmin())
        gap = best + size
        if change[best] == far:
            gap, chosen, used = capacity, used, used + 1
        else:
            chosen = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = chosen, capacity - gap
        if gap > size:
            open_bins[gap - size].append(chosen)
            count[gap - size] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; gapless from 0 in every sequence, none over ``capacity``.

    Repeated ids are separate pieces as they come; an empty table gives none.
    Pieces of equal length go by doc_id (null last), piece and checksum, so the result
    doesn't depend on how rows were dealt.
    """
    pieces = materialize(pieces, "pieces")
    shards, level = _shards(pieces.count()), 0
    packed = materialize(_pack_shards(pieces, shards, level, capacity), "packed")
    done: list[DataFrame] = []
    while shards > 1 and level < 127:  # seven bits of an id
        is_open = F.col("room") > OPEN_SHARE * capacity
        still = packed.where(is_open)
        n, bins = still.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        least = _shards(n)
        shards, level = max(least, -(-shards // MERGE_SHARDS)), level + 1
        again = materialize(_pack_shards(still, shards, level, capacity), "packed")
        saved = bins - again.where("offset = 0").count()
        if saved > LEAST_GAIN * bins:
            done.append(packed.where(~is_open))
            packed = again
        elif shards == least:
            break
    for d in done:
        packed = packed.unionByName(d)
    return packed.drop("room")


def _shards(pieces: int) -> int:
    return max(1, -(-pieces // SHARD_PIECES))


def _pack_shards(pieces: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """``pieces`` packed in ``shards`` that differ by at most one piece, whatever repeats among them."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        # Arrow keeps 64-bit ids beside nulls as they are
        rows = rows.sort_by([("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]])
        lengths = rows.column("length").to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        placed = ((level << 56) | (key[0].as_py() << 32) | bins, offsets, capacity - filled[bins])
        rows = rows.select(columns)
        for name, values in zip(("sequence_id", "offset", "room"), placed, strict=True):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    columns = [c.split()[0] for c in PIECE.split(", ")]
    if shards == 1:
        dealt = pieces.select(*columns, F.lit(0).cast("long").alias("shard"))
    else:
        # dealt by rank in the order of a hash; equal pieces lie side by side there and can change places
        salt = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
        keyed = pieces.select(*columns, F.xxhash64(*columns, F.lit(level)).alias("_pos"), salt.alias("_tie"))
        ranked = row_ranks(keyed, "_pos", "_tie", out="_rank", rows_per_bucket=SHARD_PIECES)
        dealt = ranked.select(*columns, F.pmod("_rank", F.lit(shards)).cast("long").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(pack, PLACED)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their place; see ``cut_pieces`` and ``pack_pieces``."""
    return pack_pieces(cut_pieces(docs, path, capacity, end_id), capacity)
