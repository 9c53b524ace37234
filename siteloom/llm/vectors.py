"""What the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(col: str) -> Column:
    """Whether the vector is there, has only finite components and isn't zero."""
    c = F.col(col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of one length and without nulls, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, whether it is new, rows) for each stretch of equal keys in batches sorted by them."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols))
        first = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k] != rows[first]:
                yield rows[first], rows[first] != before, batch.slice(first, k - first)
                before, first = rows[first], k


def bounded_sample(df: DataFrame, cols: list[str], key: str, size: int) -> list:
    """At most `size` rows, those with the smallest hash of key: the same ones in every run, whatever the partitions."""
    return df.select(*cols).orderBy(F.xxhash64(F.lit(17), key), key).limit(size).collect()
