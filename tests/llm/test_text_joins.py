"""Near duplicates, repeated passages and fingerprints against plain computations."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm.test_oracles import _one_of_each, _without_windows

from fleetlens.llm import hashing, jaccard_join, queries, simhash, substring_dedup


def corpus(seed=0, n=120):
    """Texts with copies, near copies in chains, shared passages and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghi") for _ in range(rng.randint(2, 4)))
    passage = [word() for _ in range(60)]
    out = [[word() for _ in range(rng.randint(0, 160))] for _ in range(n)]
    base = [word() for _ in range(150)]
    chain = base
    for _ in range(25):  # each like the one before, the ends unlike each other
        chain = list(chain)
        for _ in range(2):
            chain[rng.randrange(150)] = word()
        out.append(chain)
    out += [list(out[3]), list(out[3]), [w.upper() for w in out[4]]]
    for k in range(20):
        at = rng.randrange(len(out[k]) + 1)
        out[k] = out[k][:at] + passage[: rng.randint(30, 60)] + out[k][at:]
    out += [["la"] * 90, ["la", "li"] * 50, ["x"], ["y", "z"], ["y", "z"], [w for w in out[7]] * 2]
    return [" ".join(w) if k % 3 else "\n".join(w) for k, w in enumerate(out)] + ["", None, " \t", "ünï cödé x\x1fy"]


def test_components_of_the_complete_join(docs_of, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    monkeypatch.setattr(jaccard_join, "TILE", 8)  # tiles of bands and blocks are used
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs_of(texts)).collect()}
    firsts = set(_one_of_each(dict(enumerate(texts))))
    assert {k for k, r in got.items() if r.component_id == k} == firsts
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        assert got[i].n_shingles == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)
    kept = jaccard_join.keep_one(docs_of(texts))
    assert {r.doc_id for r in kept.collect()} == firsts


def test_near_misses_in_numbers_give_no_pairs(docs_of, monkeypatch):
    """Texts at 0.70 to 0.80 of one base, most of them unlike each other: few links and no list of what is just too unlike."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for k in range(90):
        at = rng.randrange(200)
        near = [f"k{k}x{i}" if (i - at) % 200 < 22 + k % 8 else w for i, w in enumerate(base)]
        texts.append(" ".join(near))
    seen = []
    links = jaccard_join.tile_links

    def counted(tiles, exact=False):
        seen.append(jaccard_join.materialize(links(tiles, exact), "seen"))
        return seen[-1]

    monkeypatch.setattr(jaccard_join, "tile_links", counted)
    docs = docs_of(texts)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert {k for k, c in got.items() if c == k} == set(_one_of_each(dict(enumerate(texts))))
    assert all(df.count() <= 10 * len(texts) for df in seen)


def test_a_failed_short_hash_is_tried_again(docs_of, monkeypatch):
    texts = corpus(5)
    honest, seeds = jaccard_join.short_hashes, []

    def crude(sets, seed):
        seeds.append(seed)
        out = honest(sets, seed)
        # at first every set looks like one of n equal hashes
        return out if seed else out.withColumn("bits", F.expr("unhex(repeat('01000000', CAST(length(bits) / 4 AS INT)))"))

    monkeypatch.setattr(jaccard_join, "short_hashes", crude)
    monkeypatch.setattr(jaccard_join, "LEADERS", 0)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs_of(texts)).collect()}
    assert {k for k, c in got.items() if c == k} == set(_one_of_each(dict(enumerate(texts))))
    assert len(seeds) > 1


@pytest.mark.parametrize("hot", [0, 4096])
def test_hot_shingles_and_odd_ids(docs_of, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    same = "one two three four five six seven"
    rows = [(9, same), (9, same), (None, same), (4, same.upper()), (8, None), (8, ""), (None, "lone text of its own here"), (5, "z")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs_of(rows)).collect())
    assert got == [(-1, 1, None), (-1, 3, 4), (4, 3, 4), (5, 1, 5), (8, 0, 8), (8, 0, 8), (9, 3, 4), (9, 3, 4)] or got[0][1:] == (2, None)
    assert jaccard_join.near_duplicates(docs_of([])).count() == 0
    kept = jaccard_join.keep_one(docs_of(rows)).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in kept) == [(False, ""), (False, ""), (False, same.upper()), (False, "z"), (True, "lone text of its own here")]


def test_bits_never_reject_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        a, b = (np.unique(rng.choice(pool, max(1, int(len(pool) * rng.uniform(0.6, 1))))) for _ in range(2))
        x, y = (np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in (a, b))
        d = jaccard_join.differing_bits(x, y[None, :])
        both = len(np.intersect1d(a, b))
        assert int(d[0]) <= len(a) + len(b) - 2 * both
        linked = 100 * both >= 75 * (len(a) + len(b) - both)
        assert jaccard_join.intersects(a, b) == linked
        assert not linked or jaccard_join.fits_by_bits(np.array([len(a)]), np.array([len(b)]), d)[0]


def test_connected_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(300)]
    rng.shuffle(path)
    more = [(1000 + i, 1000) for i in range(50)] + [(5000, 5000), (7, 3), (3, 7)]
    links = spark.createDataFrame(path + more, "a bigint, b bigint")
    got = {r.key: r.label for r in hashing.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}
    assert hashing.components(links.limit(0)).count() == 0


def check_dedup(got, texts):
    want = _without_windows({k: " ".join(x.decode() for x in (t or "").encode().split()).replace("\x1f", "\u0001").replace(" ", "\u0002") for k, t in texts.items()})
    for k, t in texts.items():
        kept = " ".join(want[k]).replace("\u0001", "\x1f").replace("\u0002", " ")
        assert (got[k].n_words, got[k].n_removed) == (len((t or "").encode().split()), len((t or "").encode().split()) - len(want[k])), t
        assert got[k].kept_sha256 == sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("most", [1, 4000])
def test_repeated_passages_go_everywhere(docs_of, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_SEGMENTS", most)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    texts = dict(enumerate(corpus(3)))
    got = {r.doc_id: r for r in substring_dedup.dedup_digests(docs_of(list(texts.values()))).collect()}
    check_dedup(got, texts)
    kept = substring_dedup.without_repeats(docs_of(list(texts.values())))
    assert kept.columns == docs_of(["x"]).columns
    for r in kept.collect():
        if got[r.doc_id].n_removed:
            assert sha256(r.text.encode()).hexdigest() == got[r.doc_id].kept_sha256 and r.n_chars == len(r.text)
        else:
            assert r.text == texts[r.doc_id]


def test_equal_rows_repeat_each_other(docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 0)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, " ".join(f"v{i}" for i in range(34))), (2, " ".join(f"u{i}" for i in range(40)))]
    got = substring_dedup.dedup_digests(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 34, 0), (1, 50, 50), (1, 50, 50), (2, 40, 0)]
    assert substring_dedup.dedup_digests(docs_of([])).count() == 0


def test_index_searches_like_a_scan():
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(12)]
    copies = rng.integers(1, 3, 12)
    index = substring_dedup.FMIndex(parts, copies)
    text = index.text.tolist()
    weight = np.zeros(len(text), int)
    for s, p, m in zip(index.starts.tolist(), parts, copies.tolist(), strict=True):
        weight[s : s + len(p)] = m
    ends = np.flatnonzero(np.array(text) > 0)
    for end, found in zip(ends.tolist(), index.matching_statistics(ends, 20).tolist(), strict=True):
        best = 0
        for n in range(1, 21):
            pattern = text[end - n + 1 : end + 1]
            if end - n + 1 < 0 or 0 in pattern:
                break
            if sum(int(weight[i]) for i in range(len(text) - n + 1) if text[i : i + n] == pattern) < 2:
                break
            best = n
        assert found == best
    sequence = rng.integers(0, 37, 500)
    ranks = substring_dedup.WaveletMatrix(sequence, 37)
    at = np.arange(501)
    for c in (0, 5, 36):
        assert (ranks.rank(np.full(501, c), at) == np.r_[0, np.cumsum(sequence == c)]).all()


def test_edited_texts_and_likeness(docs_of):
    rng = random.Random(6)
    long = [" ".join(rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(40)) for _ in range(150)) for _ in range(30)]
    rows = [(10 * i, t) for i, t in enumerate(long)] + [(5, None), (7, ""), (15, long[0]), (15, long[0]), (None, "é漢🙂 tail of a text"), (25, "ab")]
    distinct = {(k is None, -(k or 0), t or ""): (k, t or "") for k, t in rows}
    order = [distinct[k] for k in sorted(distinct)]
    got = simhash.edited_fingerprints(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert by[k, len(t)].edited_sha256 == sha256(edited.encode()).hexdigest(), (k, t)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id is not None}
    assert prints[0] == prints[15] and prints[5] == prints[7] == "0" * 32 and by[None, 18].n_near is None
    mean = lambda f: sum(f(r) for r in got if r.n_chars > 300) / 31
    assert mean(lambda r: r.near_edited) > 0.65 > 0.58 > mean(lambda r: r.near_next)
    assert by[0, len(long[0])].n_near == 2  # its two equal copies
    (single,) = simhash.edited_fingerprints(docs_of([(1, "abcdef")])).collect()
    assert single.edited_sha256 == sha256(b"abcdab").hexdigest() and single.near_next == 1.0
    assert simhash.edited_fingerprints(docs_of([])).count() == 0


def test_votes_by_hand(spark):
    rows = spark.createDataFrame([(1, "a b c d a b c"), (2, "a b"), (3, "d a b c d a b c x y"), (4, None)], "k int, text string")
    prints = {r.k: r.p for r in simhash.fingerprints(rows, "k").select("k", simhash.printed(F.col("hi"), F.col("lo")).alias("p")).collect()}
    for row in rows.select("k", simhash.terms(F.col("text")).alias("t")).collect():
        hashed = spark.createDataFrame([(h,) for h in row.t], "h bigint").select("h", F.xxhash64("h", F.lit(1)).alias("g")).collect()
        want = ""
        for half in (0, 1):
            ones = [sum(r[half] >> i & 1 for r in hashed) for i in range(64)]
            want += f"{sum(1 << i for i in range(64) if 2 * ones[i] > len(hashed)):016x}"
        assert prints[row.k] == want


def test_block_tables_find_every_pair_within_the_radius(spark):
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(128) for _ in range(40)]
    near = [x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 6))) for x in base for _ in range(3)]
    every = list({*base, *near})
    table = spark.createDataFrame([(signed(x >> 64), signed(x & ((1 << 64) - 1))) for x in every], "hi bigint, lo bigint")
    found = simhash.within_radius(table, table, 3).collect()
    want = sum((x ^ y).bit_count() <= 3 for x in every for y in every)
    assert len(found) == want == len(set(found))
    with pytest.raises(ValueError, match="radius"):
        simhash.within_radius(table, table, 4)


def test_neighbours_are_those_of_brute_force(spark):
    rng = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(128) for _ in range(30)]
    near = [x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 28))) for x in base for _ in range(4)]
    every = list({*base, *near, 0, (1 << 128) - 1})
    table = spark.createDataFrame([(signed(x >> 64), signed(x & ((1 << 64) - 1)), i) for i, x in enumerate(every)], "hi bigint, lo bigint, i int")
    for radius in (0, 3, simhash.NEAR_RADIUS):
        found = [tuple(r) for r in simhash.neighbours(table, table, radius).select("q_hi", "q_lo", "i", "distance").collect()]
        pairs = [(x, y) for x in range(len(every)) for y in range(len(every)) if (every[x] ^ every[y]).bit_count() <= radius]
        want = {(signed(every[x] >> 64), signed(every[x] & ((1 << 64) - 1)), y, (every[x] ^ every[y]).bit_count()) for x, y in pairs}
        assert len(found) == len(set(found)) and set(found) == want


def test_texts_with_a_few_changed_words_are_linked(docs_of):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for k in range(20):
        words = [word() for _ in range(200)]
        rows.append((20 * (k + 1), " ".join(words)))
        for j in (1, 2, 3):
            changed = list(words)
            for at in rng.sample(range(200), j):
                changed[at] = word()
            rows.append((20 * (k + 1) + j, " ".join(changed)))
    got = simhash.fingerprints_and_links(docs_of([*rows, (None, rows[0][1])])).collect()
    documents, links = [r for r in got if r.n_chars is not None], [r for r in got if r.n_chars is None]
    value = {r.doc_id: int(r.fingerprint, 16) for r in documents if r.doc_id is not None}
    members: dict[int, list] = {}
    for r in documents:
        members.setdefault(int(r.fingerprint, 16), []).append(r.doc_id)
    want = set()
    for k in range(20, 420, 20):
        for f, ids in members.items():
            d, n = (f ^ value[k]).bit_count(), len(ids) - (f == value[k])
            if d <= simhash.NEAR_RADIUS and n:
                want.add((k, f"{value[k]:032x}", f"{f:032x}", d, n))
    assert {(r.doc_id, r.fingerprint, r.near_fingerprint, r.near_distance, r.near_documents) for r in links} == want and len(links) == len(want)
    linked = {(r.doc_id, m) for r in links for m in members[int(r.near_fingerprint, 16)]}
    assert sum((k, k + j) in linked for k in range(20, 420, 20) for j in (1, 2, 3)) >= 54
    assert all(m is None or m // 20 == k // 20 for k, m in linked) and (20, None) in linked
    assert all(r.n_near == sum(x.near_documents for x in links if x.doc_id == r.doc_id) for r in documents if r.doc_id and r.doc_id % 20 == 0)


def test_query_has_a_row_per_document_and_links_beside_it(spark, tmp_path):
    """No row but those of documents: each has its length and the digest of its edited text."""
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(20, text), (21, text), (40, text), (41, None), (60, "other words"), (60, "other words"), (None, text)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op6_simhash"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((k or -1, len(t or "")) for k, t in rows)
    assert all(len(r.edited_sha256) == 64 for r in got)
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[20].links] == [(0, by[20].fingerprint, 3)] and by[20].n_near == 3
    assert by[21].links is None and by[41].links is None and [x.documents for x in by[60].links] == [1]


def test_one_pass_cuts_and_counts_and_spreads_hot_anchors(docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)  # so that some anchors are hot
    texts = corpus(seed=5)
    docs = docs_of(texts)
    cut = substring_dedup.cut_segments(docs).cache()
    sketch = hashing.merged_sketch(cut.where("slice IS NOT NULL").select("slice", "counts"))
    found = cut.where("slice IS NULL")
    assert int(sketch.sum()) == found.count() and (sketch > 3).any()
    assert all(sketch[r.slot] >= r.n for r in found.groupBy("anchor", "slot").agg(F.count("*").alias("n")).collect())
    twice = {r.anchor for r in found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").collect()}
    kept = substring_dedup.repeated_anchors(cut)
    assert twice <= {r.anchor for r in kept.collect()} and kept.join(found, ["doc_id", "h", "start"]).count() >= kept.count()
    check_dedup({r.doc_id: r for r in substring_dedup.dedup_digests(docs).collect()}, dict(enumerate(texts)))
