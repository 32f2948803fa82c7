"""Arrow list columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of `dims` entries, all of them finite, and those rows as doubles."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(ok)).flatten().cast(pa.float64())
    rows = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(rows).all(1)
    ok = ok.copy()
    ok[ok] = finite
    return ok, rows[finite]
