"""Vector columns: which rows take part, and their matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, ident: str, vector: str, zero: bool) -> DataFrame:
    """(id, v): rows with an id and a vector of finite components, as doubles; zero: all-zero vectors too."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    return df.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix of doubles."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def by_dimension(b: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length in the batch, with their matrix."""
    col = b.column(b.schema.get_field_index(name))
    lengths = np.diff(col.offsets.to_numpy())
    for n in np.unique(lengths):
        part = b if (lengths == n).all() else b.filter(pa.array(lengths == n))
        yield part, matrix(part.column(part.schema.get_field_index(name)))
