"""Incident memory: ``embeddings`` are the vectors of entries whose text is ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import incidents as incident_ops
from fleetlens.operators import jobs as job_ops
from fleetlens.operators import memory as ops
from fleetlens.queries import views
from fleetlens.queries.registry import query

QUERY_ID = 7


def sop(spark, sf_dir):
    """Memory entries: one per document, the vector of equal id attached where there is one."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    marks = views.table(spark, sf_dir, "labels")
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    base = docs.join(marks, "doc_id", "left").join(vectors, "doc_id", "left")
    metrics = F.when(
        F.col("quality").isNotNull(),
        F.struct(
            (F.col("n_chars") / 1000.0).alias("power_spike_ratio"),
            F.col("toxic").cast("double").alias("temp_rise_C"),
            F.col("quality").cast("int").alias("correlated_count"),
        ),
    )
    disposition = F.when(F.col("quality") == 1, "restart_and_watch").otherwise("page_technician")
    return base.select(
        F.col("doc_id").alias("entry_id"),
        F.col("lang").alias("type"),
        F.col("text").alias("summary"),
        disposition.alias("disposition"),
        F.col("source").alias("resolution"),
        F.concat(F.lit("INC-"), F.col("doc_id") % 50).alias("incident_id"),
        metrics.alias("metrics"),
        "embedding",
    )


def _query_vector(spark, sf_dir):
    row = views.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").first()
    return [float(x) for x in row["embedding"]]


_SIM = f"""q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {QUERY_ID}),
 s AS (SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q, q.q))) AS sim FROM embeddings e, q)"""


@query("vector_similarity", f"WITH {_SIM} SELECT vec_id, round(sim, 6) AS similarity FROM s")
def vector_similarity(spark, sf_dir):
    """Cosine of every stored vector to the query vector."""
    from fleetlens.functions.vectors import cosine_to

    rows = views.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(cosine_to("embedding", _query_vector(spark, sf_dir)), 6).alias("similarity"))


@query(
    "vector_search",
    f"""WITH {_SIM}, b AS (SELECT vec_id, sim FROM s WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY sim DESC, vec_id LIMIT 3)
    SELECT d.doc_id AS entry_id, round(b.sim, 3) AS similarity, d.lang AS type FROM b JOIN documents d ON d.doc_id = b.vec_id WHERE b.sim > 0.4""",
)
def vector_search(spark, sf_dir):
    """The three most similar entries above the floor."""
    return ops.search_vectors(sop(spark, sf_dir), _query_vector(spark, sf_dir)).select("entry_id", "similarity", "type")


_TEXT = "trim(coalesce(lang, '') || ' ' || coalesce(text, '') || ' ' || coalesce(source, ''))"


@query("text_search", f"SELECT doc_id AS entry_id, lang AS type FROM documents WHERE contains(lower({_TEXT}), 'license') ORDER BY doc_id LIMIT 3")
def text_search(spark, sf_dir):
    """Substring fallback, oldest entries first."""
    return ops.search_text(sop(spark, sf_dir), "License").select("entry_id", "type")


@query(
    "missing_vectors",
    f"SELECT doc_id AS entry_id, length({_TEXT}) AS text_length FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)",
)
def missing_vectors(spark, sf_dir):
    """Entries that still need a vector."""
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    rows = ops.missing_vectors(sop(spark, sf_dir), vectors)
    return rows.select("entry_id", F.length("text").cast("bigint").alias("text_length"))


@query(
    "outcomes",
    """WITH o AS (SELECT 'INC-' || (conv_id % 60) AS incident_id, role AS outcome, conv_id * 1000 + turn AS seq FROM conversations),
    l AS (SELECT incident_id, arg_max(outcome, seq) AS outcome FROM o GROUP BY 1),
    f AS (SELECT 'INC-' || (doc_id % 50) AS incident_id, min(doc_id) AS entry_id FROM documents GROUP BY 1)
    SELECT d.doc_id AS entry_id, l.outcome FROM documents d LEFT JOIN f ON f.entry_id = d.doc_id LEFT JOIN l ON l.incident_id = f.incident_id""",
)
def outcomes(spark, sf_dir):
    """Latest feedback on the first entry of each incident."""
    return ops.with_outcomes(sop(spark, sf_dir), _feedback(spark, sf_dir)).select("entry_id", "outcome")


def _feedback(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("INC-"), F.col("conv_id") % 60).alias("incident_id"),
        F.col("role").alias("outcome"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


@query(
    "unknown_feedback",
    """SELECT 'INC-' || (conv_id % 60) AS incident_id, count(*) AS n FROM conversations
    WHERE 'INC-' || (conv_id % 60) NOT IN (SELECT 'INC-' || (doc_id % 50) FROM documents) GROUP BY 1""",
)
def unknown_feedback(spark, sf_dir):
    """Feedback for incidents the memory does not hold."""
    return ops.unknown_feedback(sop(spark, sf_dir), _feedback(spark, sf_dir)).groupBy("incident_id").agg(F.count("*").alias("n"))


@query(
    "dispositions",
    r"""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'escalate') THEN 'ESCALATE_TO_OPS' WHEN regexp_matches(text, 'TKT-\d+') OR regexp_matches(lower(text), '\bpage\b.*technician')
    THEN 'PAGE_TECHNICIAN' ELSE 'RESTART_AND_WATCH' END AS disposition FROM conversations""",
)
def dispositions(spark, sf_dir):
    """Disposition read from each transcript turn."""
    rows = views.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", incident_ops.disposition("text").alias("disposition"))


@query(
    "sop_matrix",
    """SELECT d.doc_id AS entry_id, d.n_chars / 1000.0::DOUBLE AS power_spike_ratio, CAST(toxic AS DOUBLE) AS "temp_rise_C", CAST(quality AS DOUBLE) AS correlated_count,
    CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL""",
)
def sop_matrix(spark, sf_dir):
    """Signals and disposition label of the entries that carry metrics."""
    return job_ops.sop_matrix(sop(spark, sf_dir), keep=["entry_id"])
