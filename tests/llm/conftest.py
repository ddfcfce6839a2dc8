from __future__ import annotations

import pytest

from fleetlens.llm.queries import settings

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def configured(spark):
    settings(spark)


@pytest.fixture
def docs_of(spark):
    """Documents from texts (or (doc_id, text)), with columns whose names clash with those used inside."""

    def build(texts, lang="en", source="s"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("h", "key", "n", "bits", "score", "kept", "spans", "token", "piece", "start", "length", "_h", "_key", "_spans", "row", "worded", "rest"):
            df = df.selectExpr("*", f"'clash' AS {name}")
        return df.repartition(3)

    return build
