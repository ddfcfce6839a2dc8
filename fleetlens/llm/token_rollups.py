"""Token counts kept by deltas: signed entries per document, additive totals per group, idempotent batches.

A store is a folder with one sub-folder per committed batch, holding the batch's
ledger entries (doc_id, source, lang, version, documents, tokens; both counts
signed) and their sums per (source, lang, version). A batch of changes is turned
into entries by looking up what the ledger holds for its documents:

* insert: + the new count; if the document is there already, as revise
* revise: - what is there, + the new count (source and language may change)
* delete: - what is there; nothing if nothing is there

Totals are the sum of all batches' sums. A batch is written to a folder of its
own attempt and becomes visible by one rename; a batch id that is already
committed is left alone, so a repeated or retried batch changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD
from fleetlens.session import materialize

GROUP = ("source", "lang", "version")
LEDGER = "doc_id bigint, source string, lang string, version string, documents bigint, tokens bigint"
TOTALS = "source string, lang string, version string, documents bigint, tokens bigint"
#: Change rows: seq orders several changes of one document within a batch.
CHANGES = "op string, seq bigint, doc_id bigint, source string, lang string, version string, tokens bigint"

#: Two versions of a counting rule, so that revised counts have something to differ in.
TOKENIZERS = {"words-1": WORD, "pieces-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a version's pattern; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[version])).cast("long")


class RollupStore:
    """Committed batches in a folder all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batch(self, batch: int) -> str:
        return f"{self.folder}/batch-{batch:012d}"

    def committed(self) -> list[str]:
        """Folders of the committed batches, in order of their ids."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [str(s.getPath()) for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(f for f in found if f.rpartition("/")[2].startswith("batch-"))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{b}/{part}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``version``, ``documents``, ``tokens`` of what is there now; empty groups are left out."""
        sums = self._read("totals", TOTALS).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if that batch is already there.

        Of several changes of one document and version in a batch the last by
        ``seq`` counts (ties: the largest op, then tokens, source, lang), since
        each says what the document is from then on. Changes without a doc_id
        or version, or with an unknown op, fail the batch. Null source, lang are
        groups of their own; null tokens count 0. No changes: an empty batch.
        """
        target = self._batch(batch)
        if self._fs.exists(self._path(target)):
            return False
        attempt = f"{self.folder}/attempt-{uuid.uuid4().hex}"
        entries = self._entries(changes)
        entries.write.parquet(f"{attempt}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{attempt}/ledger")
        sums = written.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{attempt}/totals")
        done = self._fs.rename(self._path(attempt), self._path(target))
        if not done and not self._fs.exists(self._path(target)):
            raise RuntimeError(f"batch {batch} could not be committed")
        return bool(done)

    def _entries(self, changes: DataFrame) -> DataFrame:
        known = F.coalesce(F.col("op").isin("insert", "revise", "delete"), F.lit(False))
        sound = F.col("doc_id").isNotNull() & F.col("version").isNotNull() & known
        checked = changes.select(
            F.when(sound, F.col("op")).otherwise(F.raise_error(F.lit("a change without document, version or known op"))).alias("op"),
            "seq", "doc_id", "source", "lang", "version", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        )
        order = Window.partitionBy("doc_id", "version").orderBy(
            *[F.desc_nulls_last(c) for c in ("seq", "op", "tokens", "source", "lang")]
        )
        last = checked.withColumn("row", F.row_number().over(order)).where("row = 1").drop("row", "seq")
        there = (
            self.ledger()
            .join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
            .groupBy("doc_id", *GROUP)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where((F.col("documents") != 0) | (F.col("tokens") != 0))
        )
        names = [c.split()[0] for c in LEDGER.split(", ")]
        out = there.select("doc_id", *GROUP, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
        new = last.where("op <> 'delete'").select("doc_id", *GROUP, F.lit(1).cast("long").alias("documents"), "tokens")
        return out.select(names).unionByName(new.select(names))


def changes_from(docs: DataFrame, op: str, version: str, seq: int = 0) -> DataFrame:
    """One change per row of ``docs``, its tokens counted under ``version``."""
    return docs.select(
        F.lit(op).alias("op"),
        F.lit(seq).cast("long").alias("seq"),
        "doc_id",
        "source",
        "lang",
        F.lit(version).alias("version"),
        count_tokens(F.col("text"), version).alias("tokens"),
    )


def extra_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text some row with a smaller doc_id has too (compared by SHA-256)."""
    keyed = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = keyed.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(first, "_sha").where(F.col("doc_id") > F.col("_first")).select(docs.columns)


def corpus_history(docs: DataFrame, store: RollupStore) -> DataFrame:
    """Totals after a corpus was inserted, its second counts revised, and its copies deleted.

    Batch 0 inserts every document under both versions, batch 1 revises every
    document's second count after digits were taken out, batch 2 deletes extra
    copies under both versions; each batch is sent twice. Documents without an
    id can't be kept and are left out.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "source", "lang")
    one, two = TOKENIZERS
    cleaned = docs.withColumn("text", F.regexp_replace("text", "[0-9]+", ""))
    copies = materialize(extra_copies(docs).select("doc_id", "source", "lang"), "copies").withColumn("text", F.lit(""))
    batches = [
        changes_from(docs, "insert", one).unionByName(changes_from(docs, "insert", two)),
        changes_from(cleaned, "revise", two),
        changes_from(copies, "delete", one).unionByName(changes_from(copies, "delete", two)),
    ]
    for number, changes in enumerate(batches):
        for _ in range(2):
            store.apply(number, changes)
    return store.totals()
