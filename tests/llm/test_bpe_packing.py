from __future__ import annotations

import os
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from fleetlens.llm import bpe, packing  # noqa: E402

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")
#: Letters, marks, white space of all kinds, case pairs, composed and combining characters.
ALPHABET = "aAbéêȩ́ßΣσςİıǅ漢カガ゙カ12٣ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0  'sT'rE'll!?<|>endoftext🙂‍\x00½ﬁ"


def texts(n=400):
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    marks = ["<|endoftext|>", "a<|startoftext|>B<|endoftext|>", "<|endoftext"]
    return [*made, *marks, "", " ", "abc" * 2000, "ü" * 500, "Don't stop; it's 1234!!"]


def test_both_encoders_equal_the_library():
    library = Tokenizer.from_file(PATH)
    want = library.encode_batch(texts(), add_special_tokens=False)
    for encoder in (bpe.WordBpe(PATH), packing.LibraryIds(PATH)):
        for text, ids, e in zip(texts(), encoder.encode_batch(texts()), want, strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == e.ids, text
            assert encoder.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_the_three_ways_to_merge_agree():
    coder, rng = bpe.WordBpe(PATH), random.Random(1)
    words = [bytes(rng.choice(b"abcdeinotrsh") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    short = coder.merge_short(words, 64)
    for w, ids in zip(words, short, strict=True):
        single, bounds = coder.merge(w)
        assert single == ids and bounds[0] == 0 and bounds[-1] == len(w) and len(bounds) == len(ids) + 1
        assert coder._merge_long([coder.inner[b] for b in w[:-1]] + [coder.last[w[-1]]])[0] == ids
        assert "".join(coder.token[i] for i in ids) == w.decode() + "</w>"


def test_the_table_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.WordBpe(PATH)
    first = list(coder.encode_batch(["one two three four five", "one<|endoftext|>"]))
    assert list(coder.encode_batch(["one two three four five", "one<|endoftext|>"])) == first and len(coder.known) < 10


def test_documents_round_trip(spark, docs_of):
    rows = [(7, None), (None, "Hello, world"), (7, ""), (1, "x " * 50_000), (1, "x " * 50_000)]
    got = bpe.round_trip(docs_of(rows), PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 3), (1, 50_000), (1, 50_000), (7, 0), (7, 0)]
    assert bpe.round_trip(docs_of(rows).limit(0), PATH).count() == 0
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs_of([(3, "hello, world")]), PATH).collect()}
    assert Tokenizer.from_file(PATH).encode("hello, world", add_special_tokens=False).ids == ids[3]


def check_packing(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark, docs_of):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "tide's", "42"]) for _ in range(rng.randint(0, 90)))) for i in range(200)]
    rows += [(200, None), (201, "z " * 300), (201, "z " * 300)]
    placed = packing.pack_documents(docs_of(rows), PATH, capacity=64).collect()
    used = check_packing(placed, 64)
    total = 0
    for doc_id, text in dict(rows).items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in placed if p.doc_id == doc_id})
        want = [(k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert mine == want
        total += len(ids)
    assert used <= -(-sum(p.length for p in placed) // 64) + 1
    assert packing.pack_documents(docs_of([]), PATH).count() == 0


def test_several_levels_waste_no_more(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    monkeypatch.setattr(packing, "MERGE_SHARDS", 4)
    rng = random.Random(3)
    lengths = [min(100, 1 + int(rng.expovariate(0.03))) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE).repartition(5)
    placed = packing.pack_pieces(pieces, 100)
    assert placed.select("doc_id").distinct().count() == placed.count() == 1500
    assert check_packing(placed.collect(), 100) <= 1.02 * sum(lengths) / 100 + 1


def test_sum_of_squares_rule_against_trying_every_bin():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 21, 80))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 20)
    gaps: list[int] = []
    for size, b, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        fits = [g for g in gaps if g >= size]
        if not fits:
            assert b == len(gaps) and offset == 0
            gaps.append(20 - size)
            continue

        def after(gap):
            rest = [*gaps, gap - size]
            rest.remove(gap)
            return sum(rest.count(g) ** 2 for g in set(rest) if g > 0)

        best = min(after(g) for g in set(fits))
        assert gaps[b] == min(g for g in set(fits) if after(g) == best) and offset == 20 - gaps[b]
        gaps[b] -= size


def test_two_runs_give_the_same_packing(spark, docs_of):
    docs = docs_of([f"word {i} " * (i % 17) for i in range(60)])
    once, again = (
        sorted(map(tuple, packing.pack_documents(d, PATH, capacity=32).select(F.col("doc_id"), "piece", "sequence_id", "offset").collect()))
        for d in (docs, docs.repartition(7))
    )
    assert once == again


def test_no_shard_exceeds_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    monkeypatch.setattr(packing, "MERGE_SHARDS", 4)
    rng = random.Random(5)
    # no two long pieces fit together, so every bin stays open; a third of all rows are equal, under a null id
    rows = [(i, 0, 0, rng.randint(51, 90), i) for i in range(600)] + [(None, 0, 0, 60, 7)] * 300
    pieces = spark.createDataFrame(rows, packing.PIECE).repartition(5)
    placed = packing.pack_pieces(pieces, 100).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in placed))) == sorted(map(str, rows))
    assert check_packing(placed, 100) == 900
    shards: dict[int, int] = {}
    for r in placed:
        shards[r.sequence_id >> 32] = shards.get(r.sequence_id >> 32, 0) + 1
    assert max(shards.values()) <= 50


def test_no_level_packs_more_than_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    monkeypatch.setattr(packing, "MERGE_SHARDS", 4)
    pack, seen = packing._pack_shards, []

    def watched(pieces, shards, level, capacity):
        out = packing.materialize(pack(pieces, shards, level, capacity), "watched")
        seen.append((level, max(r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32)).count().collect())))
        return out

    monkeypatch.setattr(packing, "_pack_shards", watched)
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randint(20, 70), i) for i in range(700)] + [(None, 0, 0, 37, 7)] * 350
    once, again = (sorted(map(str, packing.pack_pieces(spark.createDataFrame(x, packing.PIECE).repartition(k), 100).collect())) for k, x in ((3, rows), (7, rows[::-1])))
    assert once == again
    assert max(level for level, _ in seen) >= 1 and max(n for _, n in seen) <= 50


def test_ids_beyond_doubles_beside_a_null_id(spark):
    big = 2**60 + 1
    placed = packing.pack_pieces(spark.createDataFrame([(big, 0, 0, 5, 1), (None, 0, 0, 6, 2), (big + 1, 0, 0, 7, 3)], packing.PIECE), 10)
    assert {r.doc_id for r in placed.collect()} == {big, big + 1, None}


def test_both_ways_of_parting_agree_on_latin_texts():
    rng = random.Random(2)
    letters = [chr(i) for i in range(0x180) if not bpe.BEYOND_LATIN.search(chr(i))] + list("''' stmdvelr  09")
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))).lower()
        if not bpe.BEYOND_LATIN.search(text):
            assert bpe.PIECES.findall(text) == bpe.LATIN_PIECES.findall(text)
    for other in ("naïve×2", "5 µm", "á", "x²", "日本", "œuvre ÷", "a b", "¿qué?"):
        assert list(bpe._pieces(other)) == bpe.PIECES.findall(unicodedata.normalize("NFC", other).lower())
