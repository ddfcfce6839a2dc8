"""Repairs against all edit strings, and streaming."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from fleetlens.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, place int"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        key = (t is not None, t or 0, role is not None, role or "", text is not None, text or "")
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(key, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return [r[1:] for r in sorted(out, key=lambda r: r[0])]


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def all_edits(rows, faults):
    """The least (cost, audit) over every edit string with an insert before each row, and its rows."""
    best = None
    inserts = [[], ["user"], ["assistant"]]
    per_row = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        ways = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault else 0
            ways += [(more, "K", [(role, text)]), (1 + more, "R", [("user", text)]), (1 + more, "R", [("assistant", text)])]
        per_row.append([(5 * len(i) + c, "I" * len(i) + m, [(r, "") for r in i] + o) for i in inserts for c, m, o in ways])
    per_row.append([(5 * len(i), "I" * len(i), [(r, "") for r in i]) for i in [*inserts, ["user", "assistant"]]])
    for ways in product(*per_row):
        cost, audit = sum(w[0] for w in ways), "".join(w[1] for w in ways)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        out = [r for w in ways for r in w[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = cost, audit, out
    return best


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = plain_damage([r for r in rows if r[0] == conv])
        if not mine:
            out[conv] = (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())
            continue
        faults = plain_faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, kept = all_edits(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, sha256(text.encode()).hexdigest())
    return out


def made(seed, n):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Hi.", "Yes!", "no end", "", None, " \t", "Why?\n", "ü", "Hi."]
    for conv in range(n):
        for k in range(rng.randint(0, 3)):
            turn = rng.choice([k, k, k, k + 2, None])
            rows.append((conv if conv else None, turn, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_equal_the_best_of_all_edits(spark, seed):
    rows = made(seed, 120)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    got = cr.repair_damaged(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
    assert len(got) == len({r[0] for r in rows})


def test_long_conversations_stream_in_small_batches_and_spill(spark):
    rows = [(7, i, ("user", "assistant", "assistant", "system")[zlib.crc32(b"%d" % i) % 4], f"text {i}" + "."[: i % 3]) for i in range(1000)]
    big = 2**60
    rows += [(big, big + i, "user" if i % 2 == 0 else "assistant", f"{i}!") for i in range(6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {r.conv_id: tuple(r) for r in cr.repair_damaged(df, spill_rows=64).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert small == {r.conv_id: tuple(r) for r in cr.repair_damaged(df).collect()}
    assert set(small) == {7, big} and len(small[7][7].replace("I", "")) > 900
    # the programme in one go, costs only
    mine = plain_damage([r for r in rows if r[0] == 7])
    assert small[7][6] == least_cost(mine, plain_faults(mine))


def least_cost(rows, faults):
    far = 10**9
    cost = {"": 0, "s": far, "u": far, "a": far}
    for (_, role, _), fault in zip(rows, faults, strict=True):
        for _ in range(2):
            for x in ("", "s", "a"):
                cost["u"] = min(cost["u"], cost[x] + 5)
            cost["a"] = min(cost["a"], cost["u"] + 5)
        new = {k: v + 2 for k, v in cost.items()}
        if fault not in ("blank", "duplicate"):
            more = 5 if fault else 0
            into_u = min(cost[""], cost["s"], cost["a"]) + more + (role[:1] != "u")
            into_a = cost["u"] + more + (role[:1] != "a")
            new["u"], new["a"] = min(new["u"], into_u), min(new["a"], into_a)
            if role[:1] == "s":
                new["s"] = min(new["s"], cost[""] + more)
        cost = new
    return min(cost[""], cost["a"], cost["u"] + 5, cost["s"] + 10)


def test_empty_table(spark):
    assert cr.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
