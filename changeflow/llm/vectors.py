"""Reading vectors out of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector that a column of lists holds.

    Rows whose vector is null, or holds a null, NaN or infinite component, are in none.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == size))
        matrix = flat[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield rows[fine], matrix[fine]
