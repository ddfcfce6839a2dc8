"""Document fingerprints: SimHash, and tables that find all of them within a Hamming radius.

Column expressions, grouping and joins only. Terms are five-word shingles; each
occurrence of a term votes, so a term weighs as often as it occurs. Bit i of a
fingerprint is set if more of the weight has bit i set in its hash than not. Two
votes share a 64-bit sum (lanes of 32 bits), so 128 bits take 64 sums and no
array is held per document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import let, words
from fleetlens.session import materialize

SHINGLE = 5
BITS = 128
LANES = 0x0000000100000001
LANE = 0xFFFFFFFF
#: Radius that four blocks of equal bits cover (``within_radius``).
RADIUS = 3
#: Neighbours are sought at this Jaccard likeness: sets of equal size then have a cosine of 2 J / (1 + J), and
#: fingerprints differ on average in the share angle / pi of their bits.
NEAR = 0.75
NEAR_RADIUS = round(BITS * math.acos(2 * NEAR / (1 + NEAR)) / math.pi)
#: Parts of a fingerprint that key the tables of ``neighbours``.
PART_BITS = 16
PARTS = BITS // PART_BITS


def terms(text: Column) -> Column:
    """Hashes of all five-word shingles of a text; of a shorter one that has words, its words as one term."""

    def shingles(w: Column) -> Column:
        whole = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)])
        )
        return (
            F.when(F.size(w) >= SHINGLE, whole)
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words(text), shingles)


def fingerprints(texts: DataFrame, *key: str) -> DataFrame:
    """``key`` columns, ``hi`` and ``lo``: the 128-bit fingerprint of column ``text``.

    One row per different key; equal texts have equal fingerprints. Texts
    without words, null ones too, have all bits 0. Hashes are summed where the
    text lies, so only one row per text is shuffled.
    """
    votes = texts.select(*key, F.explode_outer(terms(F.col("text"))).alias("h0")).withColumn(
        "h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0", F.lit(1)))
    )
    sums = [
        F.sum(F.shiftright(f"h{half}", i).bitwiseAND(F.lit(LANES))).alias(f"s{half}_{i}")
        for half in range(2)
        for i in range(32)
    ]
    counted = votes.groupBy(*key).agg(F.count("h0").alias("n"), *sums)

    def half(k: int) -> Column:
        def bit(i: int) -> Column:
            lane = F.col(f"s{k}_{i % 32}")
            ones = lane.bitwiseAND(F.lit(LANE)) if i < 32 else F.shiftright(lane, 32)
            return F.when(2 * ones > F.col("n"), F.lit((1 << i) - (1 << 64) * (i == 63))).otherwise(F.lit(0).cast("long"))

        return reduce(Column.bitwiseOR, map(bit, range(64)))

    return counted.select(*key, half(0).alias("hi"), half(1).alias("lo"))


def printed(hi: Column, lo: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (hi, lo)]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Bits that differ."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 for equal fingerprints, about a half for unrelated ones."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def blocks(hi: Column, lo: Column) -> Column:
    """The four blocks of 32 bits: two fingerprints within RADIUS 3 agree in at least one."""
    return F.array(*[F.shiftright(x, s).bitwiseAND(F.lit(LANE)) for x in (hi, lo) for s in (32, 0)])


def within_radius(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of different rows of two fingerprint tables (``hi``, ``lo``; no repeats) within ``radius`` bits.

    One table per block, keyed by the block's value. A pair that agrees in
    several blocks is reported from the first of them. Columns: q_hi, q_lo, hi,
    lo, distance. A larger radius than RADIUS is refused, as blocks would miss pairs.
    """
    if radius > RADIUS:
        raise ValueError(f"the block tables are complete up to a radius of {RADIUS}")

    def keyed(df: DataFrame, hi: str, lo: str) -> DataFrame:
        cols = df.select(F.col("hi").alias(hi), F.col("lo").alias(lo))
        return cols.select(hi, lo, F.posexplode(blocks(F.col(hi), F.col(lo))).alias("block", "value"))

    q, t = (F.col("q_hi"), F.col("q_lo")), (F.col("hi"), F.col("lo"))
    same = F.zip_with(blocks(*q), blocks(*t), lambda x, y: x == y)
    found = keyed(queries, "q_hi", "q_lo").alias("q").join(
        keyed(table, "hi", "lo").alias("t"),
        (F.col("q.block") == F.col("t.block"))
        & (F.col("q.value") == F.col("t.value"))
        & (distance(q, t) <= radius)
        & (F.array_position(same, True) == F.col("q.block") + 1),
    )
    return found.select("q_hi", "q_lo", "hi", "lo", distance(q, t).alias("distance"))


def part_shares(radius: int) -> list[int]:
    """Bits each part may differ by (-1: part not needed).

    Shares and one more bit per part add up to radius + 1, so two fingerprints
    that exceed the share in every part differ in more than ``radius`` bits.
    """
    return [(radius + 1) // PARTS + (k < (radius + 1) % PARTS) - 1 for k in range(PARTS)]


def _parts(hi: Column, lo: Column) -> list[Column]:
    shifts = range(64 - PART_BITS, -1, -PART_BITS)
    return [F.shiftright(x, s).bitwiseAND(F.lit((1 << PART_BITS) - 1)) for x in (hi, lo) for s in shifts]


def neighbours(queries: DataFrame, table: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """All pairs of rows of two fingerprint tables (``hi``, ``lo``; no repeats) within ``radius`` bits.

    One table per part of 16 bits, keyed by the part's value. A query looks up
    every value within the part's share (see ``part_shares``), so no pair is
    missed at any radius; the join checks the whole distance and keeps a pair
    from the first part that it meets in. Other columns of ``table`` are kept.
    Columns: q_hi, q_lo, those of ``table``, distance.
    """
    spark, shares = queries.sparkSession, part_shares(radius)
    near = [[x for x in range(1 << PART_BITS) if x.bit_count() <= share] for share in shares]
    # at most some thousand rows for radii in use
    flips = spark.createDataFrame([(k, x) for k, masks in enumerate(near) for x in masks], "part int, mask bigint")

    def key(part: Column, value: Column) -> Column:
        return F.shiftleft(part.cast("bigint"), PART_BITS).bitwiseOR(value)

    asked = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    value = F.element_at(F.array(*_parts(F.col("q_hi"), F.col("q_lo"))), F.col("part") + 1)
    probes = asked.join(F.broadcast(flips)).select("q_hi", "q_lo", key(F.col("part"), value.bitwiseXOR(F.col("mask"))).alias("key"))
    kept = [F.col(c) for c in table.columns]
    keyed = table.select(*kept, F.posexplode(F.array(*_parts(F.col("hi"), F.col("lo")))).alias("part", "value"))
    keyed = keyed.where(F.col("part").isin([k for k, share in enumerate(shares) if share >= 0]))
    keyed = keyed.select(*kept, key(F.col("part"), F.col("value")).alias("key"))

    q, t = (F.col("q_hi"), F.col("q_lo")), (F.col("hi"), F.col("lo"))
    apart = _parts(q[0].bitwiseXOR(t[0]), q[1].bitwiseXOR(t[1]))
    part = F.shiftright(F.col("p.key"), PART_BITS)
    first = [(part <= k) | (F.bit_count(x) > share) for k, (x, share) in enumerate(zip(apart, shares, strict=True))]
    condition = reduce(Column.__and__, first, (F.col("p.key") == F.col("t.key")) & (distance(q, t) <= radius))
    found = probes.alias("p").join(keyed.alias("t"), condition)
    return found.select("q_hi", "q_lo", *kept, distance(q, t).alias("distance"))


def ring(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, h) with ``next_id``, ``next_h``: the next row by descending id, after the last the first.

    Ids are range-partitioned and looked ahead within a partition; only the
    first row of every partition is needed beyond it. Null ids come last;
    equal ids go by ``h``.
    """
    spark = keys.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc_nulls_last("doc_id"), F.desc("h")]
    dealt = materialize(
        keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ring"
    )
    local = Window.partitionBy("part").orderBy(*order)
    ahead = dealt.withColumns({"row": F.row_number().over(local), "ahead": F.lead(F.struct("doc_id", "h")).over(local)})
    first = ahead.where("row = 1").select("part", F.struct("doc_id", "h").alias("head"))
    whole = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    heads = first.select(
        "part",
        F.coalesce(F.lead("head").over(whole), F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, 0))).alias("after"),
    )
    after = F.coalesce("ahead", "after")
    return ahead.join(heads, "part").select("doc_id", "h", after["doc_id"].alias("next_id"), after["h"].alias("next_h"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: fingerprints of its text, of its edited text, and their likeness to each other and the next.

    Edited text: the last floor(n / 3) code points replaced by as many first
    ones of the next document (or all it has), by descending doc_id and, for
    equal ids, by the text's hash. Null text is empty; equal rows share their
    values and each give a row; an only document is followed by itself; an
    empty table gives no row. Columns beyond doc_id and text are ignored.
    ``n_near``, for ids divisible by 20, counts the other documents within
    NEAR_RADIUS bits; it is null for the rest.
    """
    rows = _compared(docs)
    return _documents(rows, _found(rows))


def linked_fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of ``edited_fingerprints`` with ``links``: for ids divisible by 20 the classes of equal fingerprints near them.

    One row per document and no other. A link has the class's ``fingerprint`` (its
    members are the documents with that fingerprint), ``distance`` in bits and
    ``documents``, the members without the document itself; the nearest come first.
    A document's own class is listed if it has other members. Null for the other ids.
    """
    rows = _compared(docs)
    return _documents(rows, _found(rows), listed=True)


def fingerprints_and_links(docs: DataFrame) -> DataFrame:
    """The rows of ``edited_fingerprints``, and a row per link of an id divisible by 20 to a class of equal fingerprints.

    A link has ``doc_id`` and ``fingerprint`` of the document that asks,
    ``near_fingerprint`` (the class: its members are the documents with that
    ``fingerprint``), ``near_distance`` in bits and ``near_documents``, the
    members without the document itself; all else is null. A document's own
    class is listed if it has other members. Equal rows share their links.
    """
    rows = _compared(docs)
    found = materialize(_found(rows), "neighbours")
    asks = rows.where(ASKS).select("doc_id", F.col("f.hi").alias("q_hi"), F.col("f.lo").alias("q_lo")).distinct()
    others = F.col("documents") - (F.col("distance") == 0).cast("int")
    links = asks.join(found, ["q_hi", "q_lo"]).select(
        "doc_id",
        printed(F.col("q_hi"), F.col("q_lo")).alias("fingerprint"),
        printed(F.col("hi"), F.col("lo")).alias("near_fingerprint"),
        F.col("distance").alias("near_distance"),
        others.alias("near_documents"),
    )
    return _documents(rows, found).unionByName(links.where("near_documents > 0"), allowMissingColumns=True)


#: Documents whose neighbours are sought.
ASKS = "coalesce(doc_id % 20 = 0, false)"


def _compared(docs: DataFrame) -> DataFrame:
    """One written row per different (doc_id, text): ``copies``, fingerprint ``f``, edited ``e`` and that of the next, ``after``."""
    text = F.coalesce("text", F.lit(""))
    # a null id has a flag of its own, so that keys are plain columns and one shuffle of the texts serves both joins
    named = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    counted = materialize(
        named.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies")), "ids"
    )
    rows = named.select(*_key("doc_id", "id0", "id_null"), "h", "text")
    succession = materialize(ring(counted.select("doc_id", "h")), "succession")
    wanted = succession.alias("s").join(counted.alias("c"), F.expr("s.doc_id <=> c.doc_id AND s.h = c.h"))
    give = wanted.select(
        *_key("s.doc_id", "to0", "to_null"),
        F.col("s.h").alias("to_h"),
        *_key("next_id", "next0", "next_null"),
        "next_h",
        F.expr("n div 3").cast("int").alias("k"),
    ).alias("w")
    source = rows.alias("d").join(give, F.expr("d.id0 = w.next0 AND d.id_null = w.next_null AND d.h = w.next_h"))
    heads = (
        source.select("to0", "to_null", "to_h", "k", F.expr("left(text, k)").alias("head"))
        .groupBy("to0", "to_null", "to_h")
        .agg(F.max("k").alias("k"), F.max("head").alias("head"))
        .alias("p")
    )
    both = rows.alias("d").join(heads, F.expr("d.id0 = p.to0 AND d.id_null = p.to_null AND d.h = p.to_h"))
    kept = F.expr("left(text, length(text) - k)")
    doc_id = F.when(~F.col("id_null"), F.col("id0")).alias("doc_id")
    edited = both.select(doc_id, "h", "text", F.concat(kept, F.col("head")).alias("edited"))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("text"), F.lit(None).cast("string").alias("edited_sha256")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("edited_sha256")),
    )
    each = edited.select("doc_id", "h", F.length("text").cast("long").alias("n_chars"), F.explode(versions).alias("v"))
    # votes of equal rows add up, which scales a bit's sum and the count alike
    prints = materialize(
        fingerprints(each.select("doc_id", "h", "n_chars", "v.*"), "doc_id", "h", "n_chars", "version", "edited_sha256"),
        "fingerprints",
    )
    own, edit = (F.when(F.col("version") == v, F.struct("hi", "lo")) for v in (0, 1))
    docs = prints.groupBy("doc_id", "h").agg(
        F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"), F.max(own).alias("f"), F.max(edit).alias("e")
    )
    c, s, d, n = counted.alias("c"), succession.alias("s"), docs.alias("d"), docs.select("doc_id", "h", "f").alias("n")
    compared = (
        c.join(s, F.expr("c.doc_id <=> s.doc_id AND c.h = s.h"))
        .join(d, F.expr("c.doc_id <=> d.doc_id AND c.h = d.h"))
        .join(n, F.expr("s.next_id <=> n.doc_id AND s.next_h = n.h"))
        .select("c.doc_id", "c.copies", "d.n_chars", "d.edited_sha256", "d.f", "d.e", F.col("n.f").alias("after"))
    )
    return materialize(compared, "compared")


def _key(column: str, value: str, null: str) -> tuple[Column, Column]:
    return F.coalesce(column, F.lit(0).cast("long")).alias(value), F.isnull(column).alias(null)


def _found(rows: DataFrame) -> DataFrame:
    """Pairs of an asking fingerprint and a class near it, with the class's number of ``documents``."""
    table = rows.groupBy("f").agg(F.sum("copies").alias("documents")).select("f.*", "documents")
    return neighbours(rows.where(ASKS).select("f.*").distinct(), table)


def _documents(rows: DataFrame, found: DataFrame, listed: bool = False) -> DataFrame:
    others = F.col("documents") - (F.col("distance") == 0).cast("int")
    link = F.struct("distance", printed(F.col("hi"), F.col("lo")).alias("fingerprint"), others.alias("documents"))
    links = [F.array_sort(F.collect_list(F.when(others > 0, link))).alias("links")] if listed else []
    near = found.groupBy("q_hi", "q_lo").agg((F.sum("documents") - 1).alias("n_near"), *links).alias("k")
    pair = lambda x: (F.col(f"{x}.hi"), F.col(f"{x}.lo"))
    out = rows.alias("r").join(near, F.expr("r.f.hi = k.q_hi AND r.f.lo = k.q_lo"), "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(*pair("f")).alias("fingerprint"),
        printed(*pair("e")).alias("edited_fingerprint"),
        likeness(pair("f"), pair("e")).alias("near_edited"),
        likeness(pair("f"), pair("after")).alias("near_next"),
        *[F.when(F.expr(ASKS), F.col(c)).alias(c) for c in ("n_near", *(["links"] if listed else []))],
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")
