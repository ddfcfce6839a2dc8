"""Byte-pair encoding of a public vocabulary with word ends, and decoding.

A word is merged on a contiguous rank array: part boundaries, the parts' ids and
the rank of every adjacent pair lie side by side. The smallest rank is sought by
scanning, the boundary inside that pair is deleted and the ranks of the two
neighbouring pairs are looked up again. The new words of a batch are rows of one
matrix per length class and take each step together. Words beyond ``SHORT_WORD``
bytes are done singly, those beyond ``LONG_WORD`` with a heap over linked parts,
since scanning is only cheap for short ones; all three give the same ids. Merged
words are remembered in a bounded table per Python worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlens.llm.common import texts_of

NO_RANK = 1 << 30
SHORT_WORD = 64
LONG_WORD = 300
#: Words remembered per worker before the table is emptied (about 120 MB).
REMEMBERED = 600_000

#: Fixed value: the vocabulary's way of parting text (no two alternatives begin alike, so their order is free).
PIECES = regex.compile(r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

#: The same for lower-cased texts that hold only ASCII and the Latin letters up to U+017F, which the plain engine parts faster.
_LATIN = "a-zß-öø-ÿĀ-ſ"
LATIN_PIECES = re.compile(rf"[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t-\r{_LATIN}0-9]+")
BEYOND_LATIN = re.compile("[^\x00-\x7fß-öø-ÿĀ-ſ]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, spare = set(printable), iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file (a BPE model with a word-end suffix, no decoder)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        pairs = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.array(list(self.rank.values()), np.int32)[order]
        self._merged, self._inner, self._last = (np.array(x, np.int32) for x in (self.merged, self.inner, self.last))
        #: Ids of words and, under their number, of special tokens, as 4-byte little-endian numbers.
        self.known: dict[str | int, bytes] = {}

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """Ids of a word and the boundaries of their parts in bytes."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        bounds, rank = list(range(len(ids) + 1)), self.rank
        ranks = [rank.get(pair, NO_RANK) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i] = self.merged[low]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NO_RANK)
        return ids, bounds

    def _merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        kept = [i for i in range(n) if alive[i]]
        return [ids[i] for i in kept], [*kept, n]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where there is none or a part is absent (-1)."""
        pair = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 20 | right)
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], NO_RANK)

    def merge_short(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of at most ``width`` bytes, one matrix row each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = np.where(np.arange(width) < sizes[:, None], self._inner[text], -1)
        rows = np.arange(len(words))
        ids[rows, sizes - 1] = self._last[text[rows, sizes - 1]]
        ranks = self._lookup(ids[:, :-1], ids[:, 1:])
        bounds = np.broadcast_to(np.arange(width), ids.shape)
        out: list[list[int]] = [[]] * len(words)
        while len(rows):
            low = ranks.min(axis=1) if ranks.shape[1] else np.full(len(rows), NO_RANK)
            if (ended := low == NO_RANK).any():
                for r, row in zip(rows[ended].tolist(), ids[ended].tolist(), strict=True):
                    out[r] = [i for i in row if i >= 0]
                rows, ids, ranks, bounds, low = rows[~ended], ids[~ended], ranks[~ended], bounds[~ended], low[~ended]
                if not len(rows):
                    break
            at, each = ranks.argmin(axis=1), np.arange(len(rows))
            ids[each, at] = self._merged[low]
            inside = np.arange(ids.shape[1]) != at[:, None] + 1  # all but the boundary that is deleted
            ids, bounds = ids[inside].reshape(len(rows), -1), bounds[inside].reshape(len(rows), -1)
            ranks = ranks[inside[:, 1:]].reshape(len(rows), -1)
            if ranks.shape[1]:
                for first, there in ((at - 1, at > 0), (at, at < ranks.shape[1])):
                    r, c = each[there], first[there]
                    ranks[r, c] = self._lookup(ids[r, c], ids[r, c + 1])
        return out

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of new words, each as bytes."""
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for k, w in enumerate(words):
            word = w.encode("utf-8", "replace")
            classes.setdefault(next((n for n in (4, 8, 12, 16, 32, SHORT_WORD) if len(word) <= n), 0), []).append((k, word))
        out = [b""] * len(words)
        for width, members in classes.items():
            texts = [w for _, w in members]
            merged = self.merge_short(texts, width) if width else [self.merge(w)[0] for w in texts]
            for (k, _), ids in zip(members, merged, strict=True):
                out[k] = array("I", ids).tobytes()
        return out

    def _parts(self, text: str) -> list[str | int]:
        """Words of a text, and the ids of special tokens written in it."""
        if not self.special_pattern or not (marks := list(self.special_pattern.finditer(text))):
            return _pieces(text)
        parts: list[str | int] = []
        at = 0
        for m in marks:
            parts += [*_pieces(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return parts + _pieces(text[at:])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as 4-byte numbers, without special tokens added; those written in a text keep their ids.

        The words that no text before had are merged together.
        """
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if not self.known:
            self.known.update({i: array("I", [i]).tobytes() for i in self.special.values()})
        parted = [self._parts(t) for t in texts]
        new = list(set(chain.from_iterable(parted)).difference(self.known))
        known = self.known
        known.update(zip(new, self.merge_all(new), strict=True))
        return (b"".join(map(known.__getitem__, parts)) for parts in parted)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by a space, special ones included; the vocabulary has no other decoder."""
        return " ".join(map(self.token.__getitem__, ids))


def _pieces(text: str) -> list[str]:
    # lower case by single characters: the vocabulary knows no final sigma
    plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return PIECES.findall(plain) if BEYOND_LATIN.search(plain) else LATIN_PIECES.findall(plain)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """One vocabulary per Python worker and path."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``ids``: the whole texts' ids. Null or blank text: no ids; repeated rows: repeated; others ignored."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            ids = pa.array([np.frombuffer(i, np.int32) for i in bpe.encode_batch(texts_of(b.column(1)))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_column, "ids"])

    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids, one space between), ``decoded_sha256``.

    Encoding and decoding happen in one pass, so ids never leave the worker.
    Null text is empty: no tokens, digests of nothing. Null ids, repeated rows
    and an empty table pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        decimal = {i: str(i) for i in bpe.token}
        for b in batches:
            counts, digests, decoded = [], [], []
            for found in bpe.encode_batch(texts_of(b.column(1))):
                ids = np.frombuffer(found, np.uint32).tolist()
                counts.append(len(ids))
                digests.append(sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(bpe.decode(ids).encode()).hexdigest())
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
