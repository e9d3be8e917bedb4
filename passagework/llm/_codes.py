"""Reading embeddings in blocks and coding them by the strongest axes of fixed random rotations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Rows coded at once.
ROWS = 2048


@lru_cache(maxsize=64)
def rotation(dim: int, axes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(1000 + seed).standard_normal((dim, axes)).astype(np.float32)


def unit_rows(batch: pa.RecordBatch, dim: int, column: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in the batch, unit vectors in double) of the usable embeddings, block by block.

    Usable are embeddings of ``dim`` finite numbers that are not all zero; null, short, long, zero,
    infinite and NaN ones are left out.
    """
    lists = batch.column(column)
    if lists.type.value_type != pa.float64():
        lists = lists.cast(pa.list_(pa.float64()))
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    for i in range(0, len(at), ROWS):
        part = at[i : i + ROWS]
        x = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
        scale = np.abs(x).max(axis=1)
        good = np.isfinite(scale) & (scale > 0)
        part, x, scale = part[good], x[good], scale[good]
        x = x / scale[:, None]
        yield part, x / np.sqrt((x * x).sum(axis=1))[:, None]


def strongest(x: np.ndarray, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, signs): twice the strongest axis of a rotation, plus one where it is positive."""
    y = x.astype(np.float32) @ rotation(x.shape[1], axes, seed)
    c = np.abs(y).argmax(axis=1)
    return c * 2 + (y[np.arange(len(y)), c] > 0), y > 0


def copy_key(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys, equal for vectors whose unit vectors agree to six decimals."""
    q = np.rint(x * 1e6).astype(np.int64).view(np.uint64)
    keys = []
    for seed in (11, 12):
        w = np.random.default_rng(seed).integers(1, 1 << 63, x.shape[1], dtype=np.uint64) | np.uint64(1)
        keys.append(((q ^ q >> np.uint64(7)) * w).sum(axis=1, dtype=np.uint64).view(np.int64))
    return keys[0], keys[1]
