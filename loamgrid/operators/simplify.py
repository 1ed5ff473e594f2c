"""Simplification of rings, in tasks: one polygon is one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def thinned(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, from its first point and the one farthest from it; a part keeps its farthest point while
    this lies beyond the tolerance. At least four points stay."""
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    keep = {0, far, len(ring) - 1}
    offs = np.zeros(len(ring))
    todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (x, y), step = ring[a], ring[b] - ring[a]
        inner = ring[a + 1 : b] - (x, y)
        length = float(step @ step)
        along = np.clip(inner @ step / length, 0, 1)[:, None] * step if length else 0.0
        off = np.hypot(*(inner - along).T)
        k = int(off.argmax())
        offs[a + 1 : b] = off
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    for k in np.argsort(-offs, kind="stable"):
        if len(keep) >= 4:
            break
        keep.add(int(k))
    return ring[sorted(keep)]


def crosses(ring: np.ndarray) -> bool:
    """Whether two edges of a ring cross. Edges are compared block by block."""
    a, b = ring[:-1], ring[1:]
    turn = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for i in range(0, len(a), 256):
        p, q = a[i : i + 256, None], b[i : i + 256, None]
        if ((turn(p, q, a[None]) * turn(p, q, b[None]) < 0) & (turn(a[None], b[None], p) * turn(a[None], b[None], q) < 0)).any():
            return True
    return False


def simplified(rings: list, tolerance: float) -> list:
    """Each ring thinned; one that would cross itself is thinned less, by halves of the tolerance, and at last stays as it is."""
    found = []
    for ring in rings:
        points = np.array([list(x) for x in ring], float)
        step, thin = tolerance, points
        for _ in range(8):
            if len(points) < 5 or not crosses(thin := thinned(points, step)):
                break
            step, thin = step / 2, points
        found.append(thin.tolist())
    return found


def simplify(polygons: DataFrame, tolerance: float, column: str = "rings") -> DataFrame:
    """polygons with their rings simplified; null stays null."""

    at = polygons.columns.index(column)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            thin = [None if r is None else simplified(r, tolerance) for r in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(thin, batch.schema.field(at).type))

    return polygons.mapInArrow(of_rows, polygons.schema)
