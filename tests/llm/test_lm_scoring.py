"""Context-tree scores against a plain recursion, and what holds for any text."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import context_tree, lm_scoring

TRAIN = ["the cat sat on the mat", "The cat sat on a hat", "a dog, a cat\n and  Öl", "the cat sat on the mat", "x"]
OTHER = ["the dog sat", "", None, "zzz \x00 qq", " \t\n", "ÖL the mat" * 30]


def stream(text):
    w = (text or "").encode().lower().split()
    return b"".join(x + b" " for x in w) + b"\n"


def plain_tree(texts, depth):
    """(context, bits) -> [zeros, ones], and the share of the node's own estimate."""
    counts: dict[tuple[bytes, str], list[int]] = {}
    for t in texts:
        s = bytes(depth) + stream(t)
        for i in range(depth, len(s)):
            bits = f"{s[i]:08b}"
            for d in range(depth + 1):
                for k in range(8):
                    counts.setdefault((s[i - d : i], bits[:k]), [0, 0])[int(bits[k])] += 1
    own = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for n, (a, b) in counts.items()}
    weighted, share, below = {}, {}, Counter()
    for n in sorted(counts, key=lambda n: -len(n[0])):
        ctx, bits = n
        if len(ctx) == depth:
            weighted[n], share[n] = own[n], 1.0
        else:
            weighted[n] = np.logaddexp(own[n], below[n]) - math.log(2)
            share[n] = math.exp(own[n] - weighted[n]) / 2
        if ctx:
            below[ctx[1:], bits] += weighted[n]
    return counts, share


def plain_chance(tree, context, bits, depth):
    counts, share = tree
    taken, left, found = 0.0, 1.0, 0.5
    for d in range(depth + 1):
        node = (context[len(context) - d :], bits)
        if node not in counts:
            return found
        a, b = counts[node]
        own = (b + 0.5) / (a + b + 1)
        found = taken + left * own
        taken, left = taken + left * share[node] * own, left * (1 - share[node])
    return found


def plain_score(tree, text, depth):
    s, total = bytes(depth) + stream(text), 0.0
    for i in range(depth, len(s)):
        bits = f"{s[i]:08b}"
        for k in range(8):
            one = plain_chance(tree, s[i - depth : i], bits[:k], depth)
            total += math.log10(one if bits[k] == "1" else 1 - one)
    return total


@pytest.mark.parametrize(("depth", "shards", "fan"), [(3, 4, 2), (6, 16, 3), (5, 1, 1024)])
def test_scores_equal_a_plain_recursion(docs_of, depth, shards, fan):
    texts = TRAIN + OTHER
    docs = docs_of([*texts, (None, "the cat")], lang="x").repartition(4)
    got = lm_scoring.score_documents(docs, f"doc_id >= {len(TRAIN)}", depth=depth, shards=shards, fan=fan).collect()
    train = [*TRAIN, "the cat"]  # a null id is nowhere held out
    tree = plain_tree(train, depth)
    words = [w for t in train for w in [*t.encode().lower().split(), b"\n"]]
    count, v = Counter(words), len(set(words))
    assert len(got) == len(texts) + 1
    for r in got:
        text = "the cat" if r.doc_id is None else texts[r.doc_id]
        tokens = [*(text or "").encode().lower().split(), b"\n"]
        assert r.held_out == (r.doc_id is not None and r.doc_id >= len(TRAIN))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in count for w in tokens), len(words))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (len(words) + v + 1)) for w in tokens))
        want = plain_score(tree, text, depth)
        assert r.score == pytest.approx(want, rel=1e-5)
        assert r.bits_per_byte == pytest.approx(-want / math.log10(2) / len(stream(text)), rel=1e-5)


def test_next_bytes_have_total_probability_one():
    tree, depth = plain_tree(TRAIN, 4), 4
    for context in (b"\0\0\0\0", b"cat ", b"qqqq", b" the"):
        whole = 0.0
        for byte in range(256):
            bits, p = f"{byte:08b}", 1.0
            for k in range(8):
                one = plain_chance(tree, context, bits[:k], depth)
                p *= one if bits[k] == "1" else 1 - one
            whole += p
        assert whole == pytest.approx(1.0)


def test_nothing_to_learn_from_or_to_score(docs_of):
    only_held = lm_scoring.score_documents(docs_of(["ab", None]), "true").orderBy("doc_id").collect()
    assert [r.score for r in only_held] == [pytest.approx(-8 * k * math.log10(2)) for k in (4, 1)]
    assert [r.base_score for r in only_held] == [0.0, 0.0]
    assert lm_scoring.score_documents(docs_of(["ab"]).where("false"), "true").collect() == []
    everything = lm_scoring.score_documents(docs_of(["ab ab", "ab ab"])).collect()
    assert len({r.score for r in everything}) == 1 and not everything[0].held_out


def test_repeated_rows_and_long_texts(docs_of):
    text = "one two three four " * 500
    rows = [(1, text), (1, text), (2, "one two"), (3, "five")]
    small = lm_scoring.score_documents(docs_of(rows), "doc_id = 3", fan=2, block_bytes=3000, chunk_bytes=1000).collect()
    assert [r.doc_id for r in small].count(1) == 2
    large = {r.doc_id: r.score for r in lm_scoring.score_documents(docs_of(rows), "doc_id = 3").collect()}
    assert {r.doc_id: r.score for r in small} == {k: pytest.approx(v, rel=1e-6) for k, v in large.items()}


def test_held_out_texts_cost_fewer_bits_than_unrelated_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    noise = docs.select("doc_id", F.reverse("text").alias("text")).where("doc_id % 7 = 2").withColumn("doc_id", -F.col("doc_id"))
    both = docs.select("doc_id", "text").unionByName(noise)
    got = lm_scoring.score_documents(both, "doc_id % 7 = 2 OR doc_id < 0").where("held_out AND n_tokens > 20").toPandas()
    assert got[got.doc_id >= 0].bits_per_byte.median() < got[got.doc_id < 0].bits_per_byte.median() - 0.5


def test_keys_and_log_estimates():
    keys = context_tree.context_keys(np.frombuffer(b"\0\0abc", np.uint8), 2)
    assert [hex(int(k)) for k in keys] == ["0x61", "0x610062", "0x626163"]
    for a, b in ((0, 0), (3, 1), (70_000, 2), (100_000, 90_000)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        assert context_tree.log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(want)
