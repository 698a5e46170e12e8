"""Arrow columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of finite numbers, and those vectors as rows of doubles.

    Rows that are null, empty or hold a null or non-finite entry are left out.
    Vectors of different lengths raise ValueError.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(column.offsets.to_numpy()), 0)
    flat = column.flatten()  # of the rows that are not null
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    sizes = np.unique(lengths[kept])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    if not len(sizes):
        return kept, np.zeros((0, 0))
    return kept, values[np.repeat(kept, lengths)].reshape(-1, int(sizes[0]))
