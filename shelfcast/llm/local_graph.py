"""Small helpers for the inside of a task; they know nothing of Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal neighbours."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)] if len(values) else []
    return zip(edges, edges[1:])


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index each row is connected with."""
    count = len(linked)
    labels = np.arange(count)
    while True:
        best = np.minimum(labels, np.where(linked, labels[None, :], count).min(axis=1, initial=count))
        best = best[best]
        if (best == labels).all():
            return labels
        labels = best


def matrices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a column of lists without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[starts[rows][:, None] + np.arange(length)[None, :]]
