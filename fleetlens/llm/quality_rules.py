"""Quality rules with thresholds that follow each language and source.

Column expressions, grouping and joins only. Three steps: one pass gives every
document its counts; mergeable quantile sketches of rates derived from them are
summed per (language, source), per language and over all; thresholds read from
the sketches are joined back and decide.

The sketch is a log-linear histogram: a value below 64 is its own bin, a larger
one goes to one of 32 equal bins per power of two, named by its lower edge. So a
quantile is at most 1/32 too low, bins merge by adding counts in any order with
the same result, and a group has a bounded number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, let, whole_rows, words
from fleetlens.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A rate is too high above upper quartile + SPREAD x (quartile - median) + slack. The slack, in
#: thousandths (word_size: of a character), keeps groups whose quartiles coincide from rejecting noise.
SPREAD = 4
SLACK = {"symbol_rate": 50, "dup_line_rate": 250, "repeat_rate": 250, "word_size": 1500}
#: A smaller (language, source) group takes its language's sketch, and a smaller language the whole one.
MIN_GROUP = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The base counts of every whole text (null: none) beside the columns ``keep``.

    ``n_repeat_words``: words inside a 3-word window that occurs twice or more in
    the text, first occurrences included; windows are compared by a 64-bit hash.
    ``n_lines``: lines with a word. A text without words has zeros throughout.
    """
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    parts = base.select(*keep, "_t", words(F.col("_t")).alias("_w"), _lines(F.col("_t")).alias("_l"))
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": let(F.col("_w"), _repeat_words),
    }
    return parts.select(*keep, *[c.cast("long").alias(name) for name, c in counts.items()])


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def _repeat_words(w: Column) -> Column:
    """``let`` holds each array once; only a text with equal windows is sorted.

    A text with few different repeated windows looks its windows up in their
    list, any other sorts its windows together with their places.
    """

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))), lambda d: let(starts(h, d), spread))
        )

    def starts(h: Column, d: Column) -> Column:
        listed = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(d) <= 24, listed).otherwise(let(placed, among))

    def among(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i)["x"] == F.get(s, j)["x"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(k, k - 1) | same(k, k + 1)), lambda e: e["i"]))

    def spread(p: Column) -> Column:
        fresh = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), x - F.get(p, k - 1)), F.lit(3)))
        return F.aggregate(fresh, F.lit(0), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) >= 3, let(windows, count)).otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The whole numbers the adaptive rules look at; 0 where the divisor is 0."""
    pairs = {
        "symbol_rate": ("n_symbols", "word_chars"),
        "dup_line_rate": ("n_dup_lines", "n_lines"),
        "repeat_rate": ("n_repeat_words", "n_words"),
        "word_size": ("word_chars", "n_words"),
    }
    return {k: F.coalesce(F.expr(f"(1000 * {a}) div nullif({b}, 0)"), F.lit(0)) for k, (a, b) in pairs.items()}


def sketch_bin(value: Column) -> Column:
    """Lower edge of the value's bin: its six leading binary digits, the rest zero."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``rule``, ``bin``, ``n``: one sketch per group and rule; add ``n`` to merge."""
    rows = counts.select(
        "lang",
        "source",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("rule"), sketch_bin(v).alias("bin")) for k, v in rates().items()])
        ).alias("r"),
    ).select("lang", "source", "r.rule", "r.bin")
    return rows.groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, *level: str) -> DataFrame:
    """Per group of ``level`` and rule: ``size`` and ``fence``, from the merged sketches."""
    merged = sketch.groupBy(*level, "rule", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*level, "rule")
    upto = group.orderBy("bin")
    ranked = merged.withColumns({"size": F.sum("n").over(group), "upto": F.sum("n").over(upto)})
    quartile = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("size"), F.col("bin")))
    out = ranked.groupBy(*level, "rule").agg(
        F.max("size").alias("size"), quartile(50).alias("q50"), quartile(75).alias("q75")
    )
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    fence = F.col("q75") + SPREAD * (F.col("q75") - F.col("q50")) + slack[F.col("rule")]
    return out.select(*level, "rule", "size", fence.cast("long").alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) seen: the fence of each rule from the narrowest group that is large enough."""
    own = fences(sketch, "lang", "source").alias("o")
    lang = fences(sketch, "lang").alias("l")
    whole = fences(sketch).alias("w")
    joined = own.join(lang, F.expr("o.rule = l.rule AND o.lang <=> l.lang")).join(whole, F.expr("o.rule = w.rule"))
    pick = (
        F.when(F.col("o.size") >= MIN_GROUP, F.col("o.fence"))
        .when(F.col("l.size") >= MIN_GROUP, F.col("l.fence"))
        .otherwise(F.col("w.fence"))
    )
    chosen = joined.select("o.lang", "o.source", "o.rule", pick.alias("fence"))
    return chosen.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == k, F.col("fence"))).alias(f"max_{k}") for k in SLACK]
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    ``kept`` is false if ``base_failed``, else true where no rate is above the
    fence of the row's (lang, source). Null ``lang`` or ``source`` is a group of
    its own; null text has no words, so it fails. Repeated rows and ids each
    give a row; an empty table gives none; columns beyond doc_id, text, lang and
    source are ignored. The counts are written once and read for the sketches
    and for the verdicts.
    """
    counts = materialize(text_counts(docs, "doc_id", "lang", "source"), "text-counts").alias("c")
    limit = thresholds(sketches(counts)).alias("t")
    joined = counts.join(limit, F.expr("c.lang <=> t.lang AND c.source <=> t.source"), "left")
    over = None
    for k, v in rates().items():
        one = v > F.col(f"max_{k}")
        over = one if over is None else over | one
    return joined.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(over, F.lit(False))).alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged. Verdicts are found again by content, so equal rows share one."""
    key = F.xxhash64("doc_id", "text", "lang", "source")
    verdicts = quality_verdicts(docs.select(key.alias("doc_id"), "text", "lang", "source"))
    good = verdicts.where("kept").select(F.col("doc_id").alias("key")).distinct()
    return whole_rows(docs, key=key).join(good, "key", "left_semi").select("row.*")
