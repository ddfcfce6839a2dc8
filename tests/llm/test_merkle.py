"""The manifest against a plain tree, its layout, and tampering."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pytest

from fleetlens.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, lower=False):
    values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
    if lower and r.text is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([h(*n[i : i + 8]) for i in range(0, len(n), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 8])))
        i //= 8
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang, members in groups.items():
        order[lang] = sorted(members, key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees[lang] = plain_tree([plain_leaf(r) for r in order[lang]])
    top = plain_tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for k, lang in enumerate(langs):
        for i, r in enumerate(order[lang]):
            path = plain_path(trees[lang], i) + plain_path(top, k)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            folded = plain_leaf(r, tampered)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r.doc_id, plain_leaf(r), trees[lang][-1][0], root, h(*[a + b for a, b in path]), folded, folded == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_every_proof_equals_a_plain_tree(spark, docs_of, height):
    docs = docs_of([f"Text {i} Ä" for i in range(75)], lang="en")
    for lang, n, start in (("de", 1, 100), (None, 9, 200), ("", 8, 300), ("Zz", 65, 400)):
        docs = docs.unionByName(docs_of([(start + i, "AB" * i or None) for i in range(n)], lang=lang, source=None))
    twice = docs.where("doc_id = 5")
    docs = docs.unionByName(twice).unionByName(docs_of([(None, "Null"), (None, None)]))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = merkle.manifest(docs.repartition(5), height).verified().collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)
    assert {r.verified for r in got} == {True, False}


def test_many_groups(spark, docs_of):
    docs = docs_of([(i, f"t{i}") for i in range(40)]).selectExpr("doc_id", "source", "concat('l', doc_id) AS lang", "n_chars", "text")
    got = merkle.manifest(docs, 1).verified().collect()
    assert sorted(str(tuple(r)) for r in got) == plain(docs.collect())


def test_no_rows_and_one_row(docs_of):
    assert merkle.manifest(docs_of(["a"]).where("false")).verified().collect() == []
    docs = docs_of(["only"])
    (r,) = merkle.manifest(docs).verified().collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h()


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_with_halves_in_stretches(levels):
    at = {(d, i): p for d in range(levels) for i, p in enumerate(merkle.places(levels, d, np.arange(8**d)).tolist())}
    assert sorted(at.values()) == list(range(merkle.size(levels)))
    assert at[0, 0] == 0
    upper = levels // 2
    if levels > 1:
        assert max(p for (d, _), p in at.items() if d < upper) == merkle.size(upper) - 1
        rest = merkle.size(levels - upper)
        for j in range(min(8, 8**upper)):
            inside = [p for (d, i), p in at.items() if d >= upper and i >> 3 * (d - upper) == j]
            assert sorted(inside) == list(range(merkle.size(upper) + j * rest, merkle.size(upper) + (j + 1) * rest))


def test_a_stored_block_is_read_back():
    for n, alone in ((1, True), (1, False), (9, True), (700, False)):
        block = merkle.Block.build([h(str(i)) for i in range(n)], alone)
        again = merkle.Block.load(n, alone, block.dump())
        assert again.nodes == block.nodes and again.levels == block.levels
        if alone:
            assert block.root == plain_tree([h(str(i)) for i in range(n)])[-1][0]
