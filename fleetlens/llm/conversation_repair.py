"""Repair of conversations by their cheapest edits, streamed in the order of turns.

Rows are dealt by conversation, sorted by turn inside a partition and read as
Arrow batches; what is carried from row to row, and so from batch to batch, is
the dynamic programme's state: for each of four states of the output (nothing, a
system row, last a user's, last an assistant's) the least cost, the order of the
edit strings that led there, and a running hash of the repaired rows. Strings of
two states are never the start of one another, since each ends in a row's own
letter, so their order is all that ties need. What an edit came from is kept as
one byte per state and row; beyond ``spill_rows`` rows of a conversation these go to
an unnamed file of the task, as Spark's own spills do, and are read backwards
once. So memory doesn't grow with a conversation, but for its audit string.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space between words, as characters and for regular expressions.
SPACE = " \t\n\x0b\f\r"
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: Rows of one conversation whose back pointers are held in memory.
SPILL_ROWS = 1 << 16

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What keeping a truncated row costs besides.
TRUNCATED = 5
#: Output states: nothing yet, a system row only, last a user's, last an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
MOVES = ("D", "K", "R", "IK", "IR")

RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


#: The order of a conversation's rows; nulls come first.
ORDER = ("turn_no", "was_role", "was_text", "copy")


def _after(state: int) -> tuple[int, str]:
    """The state and role of the next user or assistant row."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


@dataclass
class Best:
    """The best way to a state: its cost, the rank of its edit string among the states', and a hash of its rows."""

    cost: int
    rank: int
    rows: int
    hash: object


@dataclass
class Repair:
    """One conversation's programme; ``step`` takes its rows in order, ``result`` ends it."""

    conv_id: int | None
    spill_rows: int = SPILL_ROWS
    best: dict[int, Best] = field(default_factory=lambda: {NOTHING: Best(0, 0, 0, sha256())})
    pointers: bytearray = field(default_factory=bytearray)
    spilled: object = None
    rows: int = 0
    counts: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    initial: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def observe(self, turn: str | None, role: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        if turn is not None:  # ascending
            at = int(turn)
            if self.high is None:
                self.low = at
            if at != self.high:
                self.turns += 1
            self.high = at

    def step(self, role: str, text: str, fault: str | None) -> None:
        offers: dict[int, list[tuple[int, int, str, int]]] = {}

        def offer(to: int, cost: int, state: int, move: str) -> None:
            offers.setdefault(to, []).append((cost, self.best[state].rank, move, state))

        first = role[:1]
        extra = TRUNCATED if fault == "truncated" else 0
        for state, b in self.best.items():
            offer(state, b.cost + DELETE, state, "D")
            if fault in ("blank", "duplicate"):
                continue
            for inserts, paid in (("", b.cost + extra), ("I", b.cost + extra + INSERT)):
                here = _after(state)[0] if inserts else state
                to, _ = _after(here)
                offer(to, paid + REROLE, state, inserts + "R")
                if first == ("a" if here == USER else "u"):
                    offer(to, paid + KEEP, state, inserts + "K")
                elif first == "s" and here == NOTHING:
                    offer(SYSTEM, paid + KEEP, state, "K")
        found: dict[int, Best] = {}
        chosen = {to: min(ways) for to, ways in offers.items()}
        order = {to: k for k, to in enumerate(sorted(chosen, key=lambda to: chosen[to][1:3]))}
        pointers = bytearray(4)
        for to, (cost, _, move, state) in chosen.items():
            before = self.best[state]
            out, here = [], state
            if move[0] == "I":
                here, name = _after(here)
                out.append(f"{name}:")
            if move[-1] == "K":
                out.append(f"{role}:{text}")
            elif move[-1] == "R":
                out.append(f"{_after(here)[1]}:{text}")
            found[to] = Best(cost, order[to], before.rows + len(out), _hashed(before, out))
            pointers[to] = state << 3 | MOVES.index(move)
        self.best = found
        self.pointers += pointers
        self.rows += 1
        if len(self.pointers) >= 4 * self.spill_rows:
            if self.spilled is None:
                self.spilled = tempfile.TemporaryFile()
            self.spilled.write(self.pointers)
            self.pointers.clear()

    def _backwards(self) -> Iterator[bytes]:
        """The rows' pointers from the last to the first."""
        for k in range(len(self.pointers) - 4, -1, -4):
            yield self.pointers[k : k + 4]
        if self.spilled is not None:
            step = 4 * self.spill_rows
            for at in range(self.spilled.tell() - step, -1, -step):
                self.spilled.seek(at)
                chunk = self.spilled.read(step)
                for k in range(step - 4, -1, -4):
                    yield chunk[k : k + 4]

    def result(self) -> tuple:
        ends = []
        for state, b in self.best.items():
            more = {USER: ["assistant:"], SYSTEM: ["user:", "assistant:"]}.get(state, [])
            ends.append((b.cost + INSERT * len(more), b.rank, state, more))
        cost, _, state, more = min(ends)
        hashed = _hashed(self.best[state], more)
        audit = ["I" * len(more)]
        for pointers in self._backwards():
            move, state = MOVES[pointers[state] & 7], pointers[state] >> 3
            audit.append(move)
        if self.spilled is not None:
            self.spilled.close()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), cost, "".join(reversed(audit)), hashed.hexdigest()


def _hashed(before: Best, rows: list[str]):
    """The hash of the rows so far and ``rows``, a line end between."""
    if not rows:
        return before.hash
    out = before.hash.copy()
    for k, row in enumerate(rows):
        out.update((("\n" if before.rows + k else "") + row).encode("utf-8", "surrogatepass"))
    return out


def faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row of (conv, place, role, text): blank, duplicate, truncated or null; ``place`` orders a conversation's rows.

    Whether role and text stood earlier is found by a window over equal rows, so
    a conversation's texts are never remembered in one place.
    """
    same = Window.partitionBy("conv", "role", "text").orderBy(*ORDER)
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    return rows.withColumn("_again", F.row_number().over(same) > 1).withColumn(
        "fault",
        F.when(~F.col("text").rlike(NOT_BLANK), "blank").when(F.col("_again"), "duplicate").when(~end.isin(".", "!", "?"), "truncated"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the check asks for: (conv, conv_id, turn_no, was_role, was_text, copy, role, text).

    By the checksum of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's. Nulls are one space.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    found = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        "conv_id",
        F.col("turn").alias("turn_no"),
        F.col("role").alias("was_role"),
        F.col("text").alias("was_text"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return found.where("kind <> 0").withColumn("copy", F.explode(copies)).drop("kind")


def repair(rows: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """Rows of RESULT, one per conversation, from rows like those of ``damaged``.

    Rows go by turn, nulls first; equal turns by the role and text they had, then
    by copy. A role that is neither a user's nor an assistant's nor a system's
    first row is changed or deleted; a system row elsewhere, too. Repeated rows
    are duplicates. Conversations without rows are not among the result.
    """
    marked = faults(rows).select("conv", "conv_id", "turn_no", "was_role", "was_text", "copy", "role", "text", "fault")
    dealt = marked.repartition("conv").sortWithinPartitions("conv", *ORDER)
    # ids and turns as text: pandas would make numbers with nulls floating
    sent = dealt.select("conv", F.col("turn_no").cast("string").alias("turn"), "role", "text", "fault")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Repair | None = None
        conv: str | None = None
        columns = [c.split()[0] for c in RESULT.split(", ")]

        def frame(done: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(done, columns=columns)
            out["conv_id"] = pd.array([r[0] for r in done], "Int64")
            return out

        for b in batches:
            done = []
            for name, turn, role, text, fault in zip(b["conv"], b["turn"], b["role"], b["text"], b["fault"], strict=True):
                if current is None or name != conv:
                    if current is not None:
                        done.append(current.result())
                    conv, current = name, Repair(int(name) if name else None, spill_rows)
                fault = fault if isinstance(fault, str) else None
                current.observe(turn if isinstance(turn, str) else None, role, fault)
                current.step(role, text, fault)
            if done:
                yield frame(done)
        if current is not None:
            yield frame([current.result()])

    return sent.mapInPandas(stream, RESULT)


def repair_damaged(conversations: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """Every conversation of (conv_id, turn, role, text), damaged and repaired; see ``damaged`` and ``repair``.

    A conversation that lost all its rows has zeros, no edits and the hash of
    nothing. A null conv_id is a conversation of its own; an empty table gives no
    rows; further columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows), spill_rows).withColumn("_key", _key("conv_id"))
    ids = rows.select("conv_id").distinct().withColumn("_key", _key("conv_id"))
    zero = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.alias("i").join(found.alias("f"), "_key", "left")
    return joined.select(
        "i.conv_id",
        *zero,
        F.coalesce("f.audit", F.lit("")).alias("audit"),
        F.coalesce("f.repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
