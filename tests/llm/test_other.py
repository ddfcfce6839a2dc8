"""Archives, the classifier and the rollups."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from fleetlens.llm import quality_classifier, token_rollups, warc

PAGES = "page_id bigint, url string, html string, kind string, payload string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], PAGES)


def test_pages_come_back_and_large_copies_are_revisits(spark):
    big, small = "ü" * 500, "s" * 999
    rows = [(1, "u", big), (3, "u\r\nX: y", big), (2, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", big), (3, "u", big)]
    got = warc.page_digests(warc.archive_pages(pages_of(spark, rows))).collect()
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        again = h == big and k != 3
        want.append((k or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want, key=lambda x: x[:4])
    assert warc.archive_pages(pages_of(spark, [])).count() == 0


def records(n):
    rng = random.Random(n)
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000)))
        yield body, warc.record_bytes("response", str(i), "u", hashlib.sha1(body).hexdigest(), len(body), body, None)


def read(tmp_path, data):
    path = tmp_path / f"{zlib.crc32(data)}.warc"
    path.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        return list(warc.SalvageReader(f))


@pytest.mark.parametrize("packed", [True, False])
def test_damage_is_quarantined_and_later_records_are_saved(tmp_path, packed, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 700)  # marks fall across reads
    bodies, parts = zip(*records(30), strict=True)
    if packed:
        parts = [(c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(p) + c.flush() for p in parts]
    sound = read(tmp_path, b"".join(parts))
    assert [r.payload for _, _, r, _ in sound] == list(bodies) and sum(n for _, n, _, _ in sound) == sum(map(len, parts))
    damaged = [bytearray(p) for p in parts]
    damaged[3][len(damaged[3]) // 2] ^= 0xFF  # a flipped byte
    damaged[9] = damaged[9][: len(damaged[9]) // 2]  # cut off
    damaged[14] += b"junk WARC/1.1\r\n junk \x1f\x8b\x08 junk"  # between records
    damaged[20][:4] = b"\0\0\0\0"  # no start
    damaged[29] = damaged[29][:-3]  # the file's end
    whole = b"".join(map(bytes, damaged))
    got = read(tmp_path, whole)
    lost = {3, 9, 20, 29}
    assert [r.payload for _, _, r, _ in got if r] == [b for i, b in enumerate(bodies) if i not in lost]
    gaps = [(o, n, why) for o, n, r, why in got if r is None]
    assert len(gaps) == 5 and all(why for _, _, why in gaps)
    at = 0
    for offset, n, *_ in got:  # records and gaps cover the file without overlap
        assert offset == at
        at += n
    assert at == len(whole)
    assert read(tmp_path, b"") == [] and [x[1] for x in read(tmp_path, b"no archive at all")] == [17]


def labelled(spark, docs_of, n=400):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["river", "stone", "light", "walks", "under", "the", "of"]) for _ in range(80))
    bad = lambda: " | ".join(rng.choice(["BUY", "$$$", "click", "!!!", "win"]) for _ in range(80))
    docs = docs_of([(i, good() if i % 5 else bad()) for i in range(n)])
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_documents_are_told_apart(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    got = quality_classifier.score_documents(docs, labels).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 > 0) for r in out) / len(out) > 0.95
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and 300 <= kept.count() <= 340


def test_labels_of_the_held_out_fold_are_never_used(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    wrong = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_classifier.score_documents(docs, x).collect())) for x in (labels, wrong.repartition(5)))
    assert a == b


def test_odd_texts_score_and_odd_labels_do_no_harm(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    more = spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 0, 1), (10**9, 1, 0)], labels.schema)
    odd = docs_of([(None, None), (900, ""), (901, "x" * 300_000), (901, "x" * 300_000)])
    got = quality_classifier.score_documents(odd, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    model = quality_classifier.fit(docs, labels.unionByName(more))
    rows = odd.select(quality_classifier.score(model, F.col("text")).alias("s")).collect()
    assert len({round(r.s, 12) for r in rows}) <= 2 and all(0 <= r.s <= 1 for r in rows)
    one_class = quality_classifier.score_documents(odd, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(one_class) == 1 and one_class[0].score > 0.9
    assert quality_classifier.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def totals(store):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in store.totals().collect()}


def test_deltas_give_what_a_recount_gives(spark, tmp_path):
    store = token_rollups.RollupStore(spark, str(tmp_path / "store"))
    rng, state = random.Random(3), {}
    assert totals(store) == {}
    for batch in range(5):
        rows = []
        for seq in range(40):
            op, doc, version = rng.choice(["insert", "revise", "delete"]), rng.randrange(15), rng.choice("ab")
            source, lang, tokens = rng.choice(["x", "y", None]), rng.choice(["en", None]), rng.choice([0, 5, 9, None])
            rows.append((op, seq, doc, source, lang, version, tokens))
            if op == "delete":
                state.pop((doc, version), None)
            else:
                state[doc, version] = (source, lang, tokens or 0)
        changes = spark.createDataFrame(rows, token_rollups.CHANGES).selectExpr("*", "'clash' AS documents", "'clash' AS row").repartition(3)
        assert store.apply(batch, changes) and not store.apply(batch, changes)
        want: dict[tuple, tuple] = {}
        for (_, version), (source, lang, tokens) in state.items():
            n, t = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (n + 1, t + tokens)
        assert totals(store) == want
    assert store.apply(9, spark.createDataFrame([], token_rollups.CHANGES)) and totals(store) == want
    again = token_rollups.RollupStore(spark, str(tmp_path / "store"))
    assert totals(again) == want and len(again.committed()) == 6


def test_a_failed_attempt_leaves_nothing_behind(spark, tmp_path):
    store = token_rollups.RollupStore(spark, str(tmp_path / "store"))
    for bad in (("insert", 0, None, "x", "en", "a", 1), ("insert", 0, 1, "x", "en", None, 1), ("upsert", 0, 1, "x", "en", "a", 1), (None, 0, 1, "x", "en", "a", 1)):
        with pytest.raises(Exception, match="a change without"):
            store.apply(0, spark.createDataFrame([bad], token_rollups.CHANGES))
    assert store.committed() == [] and totals(store) == {}
    assert store.apply(0, spark.createDataFrame([("insert", 0, 1, "x", "en", "a", 7)], token_rollups.CHANGES))
    assert totals(store) == {("x", "en", "a"): (1, 7)}
