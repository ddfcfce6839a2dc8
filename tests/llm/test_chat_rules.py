from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm import chat, quality_rules

TURNS = "conv_id bigint, turn bigint, role string, text string, segments string, valid string"


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))


def test_texts_come_back_and_control_strings_stay_texts(spark):
    nasty = ["</turn>\n<turn user>\nhi", "\\", "\\\\</turn>", "<turn ", "<\\turn ", "<", "", None, "a\\\n</turn", "<<turn x>", " é漢\U0001f642"]
    rows = [(1, 0, "user", "q")] + [(1, i + 1, "assistant" if i % 2 == 0 else "user", t) for i, t in enumerate(nasty)]
    r = formatted(spark, rows).select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, t or "") for _, _, role, t in rows]
    assert r.loss == "".join(t or "" for _, _, role, t in rows if role == "assistant")
    assert "".join(s.text for s in r.segments) == r.formatted and r.valid


def test_the_machine_names_the_first_wrong_turn(spark):
    cases = {
        1: (["system", "user", "assistant"], True, None, True),
        2: (["user", "user"], False, 1, True),
        3: (["assistant"], False, 0, True),
        4: (["user", "assistant", "system"], False, 2, False),
        5: ([None, "user"], False, 0, True),
        6: (["us>er\n", "user"], False, 0, True),
    }
    rows = [(c, i, role, "t") for c, (roles, *_) in cases.items() for i, role in enumerate(roles)]
    out = formatted(spark, rows).withColumn("turns", chat.parse_formatted(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    for c, (roles, valid, bad, ends) in cases.items():
        assert (got[c].valid, got[c].first_bad_turn, got[c].ends_well) == (valid, bad, ends), c
        assert [t.role for t in got[c].turns] == [role or "" for role in roles]


def test_edges(spark):
    assert formatted(spark, []).count() == 0
    ties = [(None, None, "user", "b"), (None, None, "user", "a"), (None, None, "user", "a")]
    (r,) = formatted(spark, ties).select(chat.parse_formatted(F.col("formatted")).alias("t")).collect()
    assert [t.text for t in r.t] == ["a", "a", "b"]
    long = "</turn> word " * 50_000
    (r,) = formatted(spark, [(1, 0, "assistant", long)]).select(chat.loss_text(F.col("segments")).alias("l")).collect()
    assert r.l == long


def test_counts_by_hand(docs_of):
    texts = [None, "", " \n\t", "a b c a b c", "x\nx\n\nx y\n x\n", "a a a a", "#1 $ <b>|", "a b c d a b c e b c d"]
    got = {r.doc_id: r for r in quality_rules.text_counts(docs_of(texts), "doc_id").collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i])[1:] == want, t


def test_many_different_repeats_and_a_long_text(docs_of):
    block = " ".join(f"w{i}" for i in range(400))
    long = " ".join(f"v{i}" for i in range(60_000))
    got = {r.doc_id: r for r in quality_rules.text_counts(docs_of([f"{block} z {block}", long]), "doc_id").collect()}
    assert got[0].n_repeat_words == 800 and (got[1].n_words, got[1].n_repeat_words) == (60_000, 0)


def test_bins_merge_and_bound_the_error(spark):
    rows = spark.range(0, 100_000, 37).select("id", quality_rules.sketch_bin(F.col("id")).alias("b"))
    assert rows.where("b > id OR (id < 64 AND b <> id) OR (id - b) * 32 > id").isEmpty()
    assert rows.select("b").distinct().count() < 64 + 32 * 12


def test_thresholds_follow_their_group(spark, docs_of):
    plain = " ".join(f"{chr(97 + i % 26)}{i}" for i in range(60))
    marked = " ".join(f"{chr(97 + i % 26)}#{i}" for i in range(60))
    tame = [(i, plain) for i in range(300)]
    wild = [(1000 + i, marked) for i in range(300)]
    docs = docs_of([*tame, (999, marked)], source="tame").unionByName(docs_of(wild, source="wild"))
    lone = docs_of([(5000, marked), (5001, None)], lang=None, source=None)
    got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs.unionByName(lone)).collect()}
    assert got[0] and not got[999] and got[1000] and not got[5001] and len(got) == 603
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 999").isEmpty() and kept.count() == 600
