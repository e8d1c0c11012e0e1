"""Vectors of an Arrow list column as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (float64) of the rows of a list column that have that many components, none of them null or non-finite."""
    at = lengths_of(column)
    at = np.flatnonzero(at == dimensions)
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
    found = values[offsets[at][:, None] + np.arange(dimensions)] if len(at) else np.empty((0, dimensions))
    whole = np.isfinite(found).all(axis=1)
    return at[whole], found[whole]


def lengths_of(column: pa.Array) -> np.ndarray:
    """Components of each row; -1 for a null."""
    out = np.diff(column.offsets.to_numpy())
    out[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return out


def unpacked(column: pa.Array, kind: str, dimensions: int) -> np.ndarray:
    """Rows of a binary column without nulls, each so many little-endian numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimensions)
