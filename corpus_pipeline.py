"""Five stages from raw documents to packed sequences, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import jaccard_join, packing, quality_classifier, quality_rules, substring_dedup
from fleetlens.llm.common import table
from fleetlens.llm.queries import VOCABULARY, settings
from fleetlens.session import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go."""
    settings(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go; thresholds follow the documents that came in."""
    settings(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    settings(spark)
    return jaccard_join.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words that occur more than once are taken out of the texts; all documents stay."""
    settings(spark)
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and offset."""
    settings(spark)
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", pack),
]
#: Scores, packing and their order can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder."""
    settings(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
