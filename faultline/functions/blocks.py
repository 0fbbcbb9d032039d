"""Near vectors between two bounded blocks, and signs against random hyperplanes: the NumPy part that runs in tasks.

Two blocks are compared tile by tile, so a task holds its vectors and one tile of products, however many pairs are near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors on each side of a tile.
TILE = 1_024
#: Pairs that leave a task together, and at most one tile's more.
BATCH = 50_000


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Vectors as rows of length one; zero vectors stay zero."""
    matrix = matrix.astype(np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1.0)


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    widths = np.diff(column.offsets.to_numpy(zero_copy_only=False)) if len(column) else np.zeros(1, dtype=int)
    if (widths != widths[0]).any():
        raise ValueError("vectors of one log differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), widths[0])


def signs(matrix: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """For every row and table the number its sides of ``bits`` random hyperplanes spell."""
    planes = np.random.default_rng(seed).normal(size=(matrix.shape[1], tables * bits))
    sides = (matrix @ planes >= 0).reshape(len(matrix), tables, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def true_places(marks: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask that is nearly all false and whose size divides by eight, looking at eight marks at once."""
    some = np.flatnonzero(marks.view(np.uint64))
    word, place = np.nonzero(marks.reshape(-1, 8)[some])
    return some[word] * 8 + place


class Cell:
    """The blocks ``lo`` and ``hi`` of one bucket; one and the same block where they are equal."""

    def __init__(self, key: tuple, batches: Iterator[pa.RecordBatch]):
        self.log_id, self.number, _, lo, hi = (part.as_py() for part in key)
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        ordinals, block = rows["ordinal"].to_numpy(), rows["block"].to_numpy()
        unit = unit_rows(np.vstack([matrix_of(c) for c in rows["embedding"].chunks]))
        # in ascending order, so the first of some rows is the one with the smallest ordinal
        order = np.argsort(ordinals, kind="stable")
        self.ordinals, self.unit, block = ordinals[order], unit[order], block[order]
        self.left = np.flatnonzero(block == lo)
        self.right = self.left if lo == hi else np.flatnonzero(block == hi)
        self.keys = np.vstack([matrix_of(c) for c in rows["keys"].chunks])[order] if "keys" in rows.column_names else None
        self.core = rows["core"].to_numpy()[order] if "core" in rows.column_names else None

    def near(self, eps: float, measured: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Rows of pairs within ``eps``, each pair once, with their distances if ``measured``.

        Products in single precision sort out what is surely far or surely near; what lies between is computed again.
        """
        left, right, same = self.unit[self.left], self.unit[self.right], self.right is self.left
        short_left, short_right = left.astype(np.float32), right.astype(np.float32)
        # more than single precision can be wrong by
        doubt = 1.2e-7 * (left.shape[1] + 4)
        least, surely = np.float32(1 - eps - doubt), np.float32(1 - eps + doubt)
        room = min(TILE, len(left)) * min(TILE, len(right))
        products, marks = np.empty(room, dtype=np.float32), np.empty(room + 7, dtype=bool)
        for at in range(0, len(left), TILE):
            for to in range(at if same else 0, len(right), TILE):
                one, other = short_left[at : at + TILE], short_right[to : to + TILE]
                size = len(one) * len(other)
                rough = np.matmul(one, other.T, out=products[:size].reshape(len(one), len(other))).ravel()
                np.greater_equal(rough, least, out=marks[:size])
                marks[size : size + 7] = False
                found = true_places(marks[: -(-size // 8) * 8])
                if not len(found):
                    continue
                i, j = np.divmod(found, len(other))
                if same and at == to:
                    once = i < j
                    found, i, j = found[once], i[once], j[once]
                i, j = at + i, to + j
                if self.number:
                    # a pair counts in the first table whose bucket it shares
                    mine, theirs = self.keys[self.left[i], : self.number], self.keys[self.right[j], : self.number]
                    once = ~(mine == theirs).any(axis=1)
                    found, i, j = found[once], i[once], j[once]
                unsure = slice(None) if measured else np.flatnonzero(rough[found] < surely)
                if len(i[unsure]) * 50 > size:
                    product = (left[at : at + TILE] @ right[to : to + TILE].T)[i[unsure] - at, j[unsure] - to]
                else:
                    product = np.einsum("ij,ij->i", left[i[unsure]], right[j[unsure]])
                distance = np.clip(1.0 - product, 0.0, 2.0)
                near = np.ones(len(i), dtype=bool)
                near[unsure] = distance <= eps
                if near.any():
                    yield self.left[i[near]], self.right[j[near]], distance[near] if measured else None

    def rows(self, **columns: np.ndarray) -> pa.RecordBatch:
        count = len(next(iter(columns.values())))
        arrays = [pa.repeat(pa.scalar(self.log_id, pa.string()), count), *(pa.array(c) for c in columns.values())]
        return pa.RecordBatch.from_arrays(arrays, names=["log_id", *columns])


def pairs(cell: Cell, eps: float) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in cell.near(eps, True):
        held.append(part)
        size += len(part[0])
        if size >= BATCH:
            yield _pair_rows(cell, held)
            held, size = [], 0
    if held:
        yield _pair_rows(cell, held)


def _pair_rows(cell: Cell, held: list[tuple]) -> pa.RecordBatch:
    i, j, distance = (np.concatenate(parts) for parts in zip(*held))
    a, b = cell.ordinals[i], cell.ordinals[j]
    return cell.rows(a=np.minimum(a, b), b=np.maximum(a, b), distance=distance)


def pair_count(cell: Cell, eps: float) -> Iterator[pa.RecordBatch]:
    yield cell.rows(pairs=np.array([sum(len(i) for i, _, _ in cell.near(eps))], dtype=np.int64))


def degrees(cell: Cell, eps: float) -> Iterator[pa.RecordBatch]:
    """How many others are near each vector."""
    count = np.zeros(len(cell.ordinals), dtype=np.int64)
    for i, j, _ in cell.near(eps):
        count += np.bincount(i, minlength=len(count)) + np.bincount(j, minlength=len(count))
    some = np.flatnonzero(count)
    yield cell.rows(ordinal=cell.ordinals[some], near=count[some])


def joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row every row can reach, after the rows ``a`` and ``b`` have been linked."""
    while True:
        a, b = roots[a], roots[b]
        apart = a != b
        if not apart.any():
            return roots
        a, b = a[apart], b[apart]
        roots = roots.copy()
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def links(cell: Cell, eps: float) -> Iterator[pa.RecordBatch]:
    """Core vectors with the first of those they are linked to within the cell, and all pairs of a core vector and another.

    Comparing ends once all core vectors of the cell are linked, if it holds no others.
    """
    core, roots = cell.core, np.arange(len(cell.ordinals))
    only_core = bool(core.all())
    for i, j, _ in cell.near(eps):
        both = core[i] & core[j]
        roots = joined(roots, i[both], j[both])
        if only_core:
            if not roots.any():
                break
            continue
        edge = core[i] != core[j]
        i, j = i[edge], j[edge]
        if len(i):
            outer, inner = np.where(core[i], j, i), np.where(core[i], i, j)
            yield cell.rows(a=cell.ordinals[outer], b=cell.ordinals[inner], border=np.ones(len(i), dtype=bool))
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    yield cell.rows(a=cell.ordinals[moved], b=cell.ordinals[roots[moved]], border=np.zeros(len(moved), dtype=bool))
