"""Density clustering of one log's template vectors: the NumPy part that runs inside tasks.

The caller bounds the vectors of a group, so the neighbour matrix has a fixed upper size. Only labels leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def distances(matrix: np.ndarray) -> np.ndarray:
    """Cosine distances; a zero vector is at distance 1 from everything."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(lengths > 0, lengths, 1.0)
    return np.clip(1.0 - unit @ unit.T, 0.0, 2.0)


def density_labels(near: np.ndarray, min_samples: int) -> np.ndarray:
    """Labels from a symmetric neighbour matrix, numbered by lowest core member; -1 is noise."""
    size = len(near)
    core = near.sum(axis=1) >= min_samples
    labels = np.full(size, -1)
    following = 0
    for start in np.flatnonzero(core):
        if labels[start] != -1:
            continue
        # grow one component over core points, a whole frontier at a time
        member = np.zeros(size, dtype=bool)
        member[start] = True
        frontier = member.copy()
        while frontier.any():
            reached = near[frontier].any(axis=0) & core & ~member
            member |= reached
            frontier = reached
        # border points go to the first component that reaches them
        border = near[member].any(axis=0) & (labels == -1)
        labels[border | member] = following
        following += 1
    return labels


def label_matrix(matrix: np.ndarray, eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and centrality of every vector of one log; a single vector gets label 0."""
    if len(matrix) == 1:
        labels = np.zeros(1, dtype=int)
    else:
        labels = density_labels(distances(matrix) <= eps, min_samples)
    centrality = np.ones(len(matrix))
    for found in np.unique(labels[labels >= 0]):
        members = labels == found
        centre = matrix[members].mean(axis=0)
        length = np.linalg.norm(centre)
        centrality[members] = matrix[members] @ (centre / (length if length > 0 else 1.0))
    return labels, centrality


def _labelled(rows: pa.Table, starts: list[int], eps: float, min_samples: int) -> Iterator[pa.RecordBatch]:
    """The labels of whole logs, of which each begins at one of ``starts``."""
    vectors = rows["embedding"].combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    found = []
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        matrix = values[ends[start] : ends[end]].reshape(end - start, int(sizes[start]))
        found.append((np.arange(end - start), *label_matrix(matrix, eps, min_samples)))
    row, label, centrality = (np.concatenate(column) for column in zip(*found, strict=True))
    made = {"log_id": rows["log_id"], "ordinal": rows["ordinal"], "row": row, "label": label, "centrality": centrality}
    yield from pa.table(made).to_batches()


def labelled(batches: Iterator[pa.RecordBatch], eps: float, min_samples: int) -> Iterator[pa.RecordBatch]:
    """``log_id, ordinal, row, label, centrality`` of vectors (``log_id, ordinal, embedding``) that come log by log and in
    order. Batches hold many small logs; one that a batch cuts waits for its other rows."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        ids = rows["log_id"].to_pylist()
        starts = [i for i, log in enumerate(ids) if i == 0 or log != ids[i - 1]]
        if len(starts) > 1:
            yield from _labelled(rows.slice(0, starts[-1]), starts[:-1], eps, min_samples)
        held = rows.slice(starts[-1]) if starts else None
    if held is not None:
        yield from _labelled(held, [0], eps, min_samples)
