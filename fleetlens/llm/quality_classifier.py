"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from text labelled good, one from text labelled bad. A
text is compressed in blocks with each; the difference of the summed sizes over
their total is turned into a probability by a logistic curve, fitted on labelled
texts the dictionaries have not seen and weighted to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
THRESHOLD = 0.3
#: Bound of the training sample: rows per class, and bytes of the longest text in it.
ROWS_PER_CLASS = 2000
LONGEST_TRAINED = 1 << 16
DICTIONARY_BYTES = 32 << 10
#: Long texts are compressed in blocks, so that the dictionary counts throughout.
BLOCK = 1024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    slope: float
    offset: float


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text divisible by ``FOLDS``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, bool, str]], dict[int, int]]:
    """At most ``ROWS_PER_CLASS`` labelled texts per class in hash order, as (label, even half, text); class sizes.

    Ids are drawn from the labels first, so only a bounded list is joined with
    the documents. An id labelled twice counts once, with its larger label.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
    )
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    drawn = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(ROWS_PER_CLASS) for q in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("_id"), "quality")
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.length("text") <= LONGEST_TRAINED)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .select("quality", F.pmod(order, F.lit(1024)).alias("h"), "text")
        .orderBy("h", "quality", "text")
    )
    return [(r["quality"], r["h"] % 2 == 0, r["text"]) for r in rows.collect()], sizes


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few texts to train one, their plain content."""
    pieces = [t[k : k + 4 * BLOCK] for t in texts for k in range(0, len(t), 4 * BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES] or b"\n"


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def size_difference(text: bytes, bad: bytes, good: bytes) -> float:
    """(bad size - good size) / (bad size + good size) over the whole text; 0 for an empty one."""
    if not text:
        return 0.0
    with_bad, with_good = _compressor(bad), _compressor(good)
    b = g = 0
    for k in range(0, len(text), BLOCK):
        block = text[k : k + BLOCK]
        b += len(with_bad.compress(block))
        g += len(with_good.compress(block))
    return (b - g) / (b + g)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a weak prior on the slope."""
    design = np.column_stack([x, np.ones_like(x)])
    beta, ridge = np.zeros(2), np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(
            (design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta
        )
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries from one half of the sample, the curve from the other.

    Without labelled texts of both classes the score is the good class's share
    of the labels (a half without any) for every text.
    """
    sample, sizes = training_sample(docs, labels)
    halves = {(q, h): [t.encode() for c, even, t in sample if c == q and even == h] for q in (0, 1) for h in (True, False)}
    if not all(halves.values()):
        share = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + sizes.get(1, 0) + 1)
        return Model(b"\n", b"\n", 0.0, float(np.log(share / (1 - share))))
    bad, good = (build_dictionary(halves[q, True]) for q in (0, 1))
    x, y, weight = [], [], []
    for q in (0, 1):
        texts = halves[q, False]
        x += [size_difference(t, bad, good) for t in texts]
        y += [q] * len(texts)
        weight += [sizes[q] / len(texts)] * len(texts)
    w = np.array(weight)
    slope, offset = _logistic(np.array(x), np.array(y, float), w * len(w) / w.sum())
    return Model(bad, good, slope, offset)


def score(model: Model, text: Column) -> Column:
    """The probability that ``text`` is good, as a column; null text is empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([size_difference((t or "").encode("utf-8", "replace"), model.bad, model.good) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30))))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Null and empty texts score like a text without a difference. Repeated rows
    each get a row, an empty table none; other columns are ignored.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``THRESHOLD``, unchanged."""
    return docs.where(score(fit(docs, labels), F.col("text")) >= THRESHOLD)
