"""The operators' queries against their SQL on the smallest tables, and what every query must give."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from fleetlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str(tuple(r)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, duck):
    """Each stage against a plain computation on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "n-gram jaccard join", "substring dedup", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        if name != "best-fit packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert 0 < len(after) <= len(before) and set(after) <= set(before)
        if name == "n-gram jaccard join":
            assert after == _one_of_each(before)
        elif name == "substring dedup":
            assert set(after) == set(before) and {k: (v or "").split() for k, v in after.items()} == _without_windows(before)
        elif name in ("quality classifier", "quality rules"):
            assert all(before[k] == v for k, v in after.items())
    sums: dict[int, int] = {}
    for r in docs.collect():
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert max(sums.values()) <= 2048 and {r.doc_id for r in docs.collect()} == set(before)


def _one_of_each(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    found = {k: k for k in sets}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                found[y] = x
    return {k: texts[k] for k in keys if root(k) == k}


def _without_windows(texts):
    words = {k: (t or "").split() for k, t in texts.items()}
    seen: dict[tuple, int] = {}
    for w in words.values():
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    out = {}
    for k, w in words.items():
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        out[k] = [x for i, x in enumerate(w) if i not in gone]
    return out


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="test tables absent")
def test_quality_rules_where_groups_have_fences_of_their_own(spark):
    """On both sides of the group size that the SQL switches at."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{LARGER}/documents.parquet'")
    sizes = [n for (n,) in con.execute("SELECT count(*) FROM documents GROUP BY lang, source").fetchall()]
    assert min(sizes) < 200 <= max(sizes)
    df = QUERIES["op4_quality_rules"](spark, LARGER)
    cur = con.execute(ORACLES["op4_quality_rules"])
    cols = [d[0] for d in cur.description]
    want = sorted(str(tuple(r)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want
