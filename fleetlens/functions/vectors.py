"""Vector similarity, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_to(vector: str | Column, query: Sequence[float]) -> Column:
    """Cosine of an array column to ``query``; 0 when a norm is 0, NULL for a NULL vector.

    Unequal lengths use the common prefix in the dot product and full norms.
    """
    q = np.asarray(query, dtype="float64")
    q_norm = float(np.sqrt((q * q).sum()))

    @F.arrow_udf("double")
    def cosine(col: pa.Array) -> pa.Array:
        lengths = np.asarray(col.value_lengths().fill_null(0))
        flat = np.asarray(col.flatten().cast(pa.float64()))
        missing = np.asarray(col.is_null())
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype("int64") if len(lengths) else lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(flat)) - starts[row] if len(flat) else np.zeros(0, dtype="int64")
        weights = np.where(place < len(q), q[np.minimum(place, len(q) - 1)], 0.0) if len(q) else np.zeros(len(flat))
        dots = np.bincount(row, weights=flat * weights, minlength=len(lengths))
        norms = np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(lengths))) * q_norm
        out = np.divide(dots, norms, out=np.zeros(len(lengths)), where=norms > 0)
        return pa.array(out, type=pa.float64(), mask=missing)

    return cosine(F.col(vector) if isinstance(vector, str) else vector)
