"""Chat formatting: a declarative template, a role machine, text segments with loss flags.

Column expressions only. A conversation is ordered by turn (ties: by role, then
text; null turns first), turned into segments and kept as one row, because its
formatted text and its digests are single values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import let

START = "start"


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like, which roles may follow which, and what is learnt.

    ``open`` + role + ``head_end`` + text + ``close``. ``open`` and ``close`` are
    the control strings: each starts with its only ``<``, neither begins the
    other and none holds a backslash, so one can't arise across a border
    between text and control string. ``follows`` is the machine: the state is
    the role of the turn before (``start`` at first).
    """

    open: str = "<turn "
    head_end: str = ">\n"
    close: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant", "user")

    def __post_init__(self) -> None:
        for c in (self.open, self.close):
            if len(c) < 2 or not c.startswith("<") or c.count("<") != 1 or "\\" in c:
                raise ValueError(f"not a usable control string: {c!r}")
        if self.open.startswith(self.close) or self.close.startswith(self.open):
            raise ValueError("one control string begins the other")
        if not self.head_end.startswith(">"):
            raise ValueError("the head of a turn has to end with '>'")

    @property
    def marks(self) -> tuple[str, str]:
        """What is broken up inside texts: the control strings without line ends."""
        return self.open.rstrip("\n"), self.close.rstrip("\n")


def escape(text: Column, template: ChatTemplate) -> Column:
    """Backslashes are doubled; a control string gets one after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.marks:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def escape_role(role: Column, template: ChatTemplate) -> Column:
    """As a text, and no bare ``>``, which would end the head."""
    return F.replace(escape(role, template), F.lit(">"), F.lit("\\>"))


def unescape(text: Column) -> Column:
    """Inverse of both: a backslash is dropped and what follows it is kept."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per ``conv_id``: ``segments`` (text, loss), ``formatted``, ``valid``, ``first_bad_turn``, ``ends_well``.

    All turns are formatted, also those the machine refuses; ``valid`` says
    whether every turn was allowed, ``first_bad_turn`` is the position (from 0)
    of the first one that was not, ``ends_well`` whether the last role may end a
    conversation. Null text or role: empty (an empty role is not allowed
    anywhere). Null ``conv_id``: a conversation of its own. Repeated rows stay
    repeated turns. No rows: no conversations. Further columns are ignored.
    """
    t = template or ChatTemplate()
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = [F.struct(F.lit(a), F.lit(b)) for a, to in t.follows.items() for b in to]

    def segments(x: Column) -> Column:
        def plain(text: Column) -> Column:
            return F.struct(text.alias("text"), F.lit(False).alias("loss"))

        return F.array(
            plain(F.concat(F.lit(t.open), escape_role(x["role"], t), F.lit(t.head_end))),
            F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.trained).alias("loss")),
            plain(F.lit(t.close)),
        )

    def bad(turns: Column) -> Column:
        steps = F.transform(
            turns,
            lambda x, i: F.struct(F.when(i == 0, F.lit(START)).otherwise(turns[F.greatest(i - 1, F.lit(0))]["role"]), x["role"]),
        )
        return let(steps, lambda s: F.array_position(F.transform(s, lambda x: ~x.isin(*allowed)), True))

    out = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        let(F.col("turns"), bad).alias("bad"),
        F.element_at("turns", -1)["role"].isin(*t.final).alias("ends_well"),
    )
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("bad") == 0).alias("valid"),
        F.when(F.col("bad") > 0, (F.col("bad") - 1).cast("long")).alias("first_bad_turn"),
        "ends_well",
    )


def parse_formatted(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """Turns (role, text) read back from the formatted text alone."""
    t = template or ChatTemplate()
    pieces = F.split(formatted, _quoted(t.close), -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)
    head = rf"^{_quoted(t.open)}((?:[^\\>]|\\[\s\S])*){_quoted(t.head_end)}"

    def turn(body: Column) -> Column:
        return F.struct(
            unescape(F.regexp_extract(body, head, 1)).alias("role"),
            unescape(F.regexp_replace(body, head, "")).alias("text"),
        )

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"
