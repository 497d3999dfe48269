"""Arrow columns as NumPy arrays, and the joins and groupings of kernels that work on batches of whole keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins among the members (n + 1 numbers), and the members; a null is an empty list."""
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(count)]), lists.flatten()


def coded(values: pa.Array) -> np.ndarray:
    """A number for each distinct value, from 0; -1 for null."""
    if pa.types.is_null(values.type):
        return np.full(len(values), -1, np.int64)
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One number a row, equal where all columns are."""
    out = np.zeros(columns[0].size, np.int64)
    if not out.size:
        return out
    top = 0
    for c in columns:
        low, high = int(c.min()), int(c.max())
        if (top + 1) * (high - low + 1) > 1 << 62:
            out, c = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (out, c))
            top, low, high = int(out.max()), 0, int(c.max())
        out = out * np.int64(high - low + 1) + (c - low)
        top = top * (high - low + 1) + high - low
    return out


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``low`` to under ``high`` of each row, and the row of each."""
    count = high - low
    of = np.repeat(np.arange(count.size), count)
    return of, np.arange(of.size) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(ordered.size, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code point of every character; a null has none."""
    n, text = len(texts), "".join(x for x in texts.to_pylist() if x)
    char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.repeat(np.arange(n), pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)), char
