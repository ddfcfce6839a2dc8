"""Memory of past incidents: append, feedback, similarity and text search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.vectors import cosine_to

TOP_K = 3
MIN_SIMILARITY = 0.4


def entry_text() -> Column:
    """Searchable text of an entry."""
    return F.trim(
        F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("type", "summary", "resolution")])
    )


def search_vectors(sop: DataFrame, query: Sequence[float], top_k: int = TOP_K, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The most similar entries above the floor (3 dp); entries without a vector are skipped.

    Scores come from a narrow read of ids and vectors, and only the winners' rows are
    looked up again.
    """
    scored = sop.where("embedding IS NOT NULL").select("entry_id", cosine_to("embedding", query).alias("_s"))
    best = scored.orderBy(F.desc("_s"), "entry_id").limit(top_k).where(F.col("_s") > min_similarity)
    # top_k rows
    return (
        sop.drop("embedding")
        .join(F.broadcast(best), "entry_id")
        .select(F.round("_s", 3).alias("similarity"), *[c for c in sop.columns if c != "embedding"])
        .orderBy(F.desc("similarity"), "entry_id")
    )


def search_text(sop: DataFrame, query: str, top_k: int = TOP_K) -> DataFrame:
    """Substring fallback: entries whose text contains the query, oldest first."""
    hits = sop.where(F.contains(F.lower(entry_text()), F.lit(query.lower())))
    return hits.drop("embedding").orderBy("entry_id").limit(top_k)


def append_resolution(sop_path: str, record: DataFrame) -> None:
    """Append resolved incidents (same schema, new ``entry_id``)."""
    record.write.mode("append").parquet(sop_path)


def missing_vectors(sop: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries that still need a vector."""
    return sop.join(vectors.where("embedding IS NOT NULL"), "entry_id", "left_anti").select("entry_id", entry_text().alias("text"))


def with_vectors(sop: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach the newest vector (largest ``version``) of each entry; none leaves NULL."""
    newest = vectors.groupBy("entry_id").agg(F.max_by("embedding", "version").alias("embedding"))
    base = sop.drop("embedding")
    return base.join(newest, "entry_id", "left")


def with_outcomes(sop: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attach the latest outcome of each incident to its first entry.

    ``outcomes(incident_id, outcome, seq)``; later feedback wins.
    """
    latest = outcomes.groupBy("incident_id").agg(F.max_by("outcome", "seq").alias("_outcome"))
    first = sop.groupBy("incident_id").agg(F.min("entry_id").alias("_first"))
    tagged = first.join(latest, "incident_id").select(F.col("_first").alias("entry_id"), F.col("_outcome").alias("outcome"))
    return sop.join(tagged, "entry_id", "left")


def unknown_feedback(sop: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Feedback for incidents that have no entry (the caller reports these as errors)."""
    return outcomes.join(sop.select("incident_id").distinct(), "incident_id", "left_anti")


def feedback_text() -> Column:
    """Text to embed again after feedback."""
    return F.concat(entry_text(), F.lit(" outcome:"), F.col("outcome"))
