"""Plane geometry of polygons against polygons: shared areas, meeting, containment, repair.

Polygons are arrays of rings (the outer one first, then holes), each a closed array of points. Rows hold the polygons that a cell
join has brought together; they are worked on by batch, over flat arrays of edges.

Areas are sums of signed trapezoids: a polygon is what lies below its upper edges less what lies below its lower ones, so the area
that several polygons share is the sum, over edges of each, of the integral of the lowest of these edges. This is exact for concave
rings and for holes, and needs no ring of the shared part.

A null polygon, or one without edges, shares nothing with any other. Rings that run either way are taken as they are meant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
POLYGONS = T.ArrayType(RINGS)
#: Edges of one polygon against those of another that are worked on at once.
CHUNK = 1 << 18
#: Tasks for each core where rows are dealt out for work in Python.
SHARES = 4
#: Part of an area that rounding may take.
TINY = 1e-9


@dataclass
class Edges:
    """Edges of many polygons: row of each, in order; ends; how the ring runs (1: as meant, the inside on the left)."""

    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    turn: np.ndarray
    rows: int

    def area(self) -> np.ndarray:
        x, y = self.a, self.b
        origin = np.zeros((self.rows, 2))
        origin[self.row[::-1]] = x[::-1]  # about the first point of each
        x, y = x - origin[self.row], y - origin[self.row]
        return np.bincount(self.row, self.turn * (x[:, 0] * y[:, 1] - y[:, 0] * x[:, 1]) / 2, self.rows)


def edges(column: pa.Array) -> Edges:
    """Of a column of polygons."""
    polygon, ring = _ends(column), _ends(column.flatten())
    point = np.asarray(column.flatten().flatten().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 2)
    last = np.zeros(len(point), bool)
    last[ring[1:][ring[1:] > ring[:-1]] - 1] = True
    at = np.flatnonzero(~last)
    of_ring = np.repeat(np.arange(len(ring) - 1), np.diff(ring))
    of_row = np.repeat(np.arange(len(polygon) - 1), np.diff(polygon))
    a, b, own = point[at], point[at + 1] if len(at) else point[:0], of_ring[at]
    first = np.zeros((len(ring) - 1, 2))
    first[of_ring[::-1]] = point[::-1]
    x, y = a - first[own], b - first[own]
    signed = np.bincount(own, x[:, 0] * y[:, 1] - y[:, 0] * x[:, 1], len(ring) - 1)
    outer = np.zeros(len(ring) - 1, bool)
    outer[polygon[:-1][np.diff(polygon) > 0]] = True
    turn = np.where((signed >= 0) == outer, 1.0, -1.0)
    return Edges(of_row[own], a, b, turn[own], len(polygon) - 1)


def _ends(column: pa.Array) -> np.ndarray:
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of all items of left and right (sorted rows) that are of one row, in parts."""
    n = np.bincount(right, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    many = n[left]
    at = 0
    ends = np.cumsum(many)
    while at < len(left):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        own = np.repeat(np.arange(at, end), many[at:end])
        step = np.arange(len(own)) - np.repeat(ends[at:end] - many[at:end] - base, many[at:end])
        yield own, first[left[own]] + step
        at = end


def shared_areas(polygons: list[Edges]) -> np.ndarray:
    """For each row the area that all its polygons share."""
    rows = polygons[0].rows
    base = np.full(rows, np.inf)
    upright = []
    for p in polygons:
        np.minimum.at(base, p.row, np.minimum(p.a[:, 1], p.b[:, 1]))
        use = p.a[:, 0] != p.b[:, 0]
        a, b, row = p.a[use], p.b[use], p.row[use]
        swap = (a[:, 0] > b[:, 0])[:, None]
        upright.append((row, np.where(swap, b, a), np.where(swap, a, b), np.where(swap[:, 0], 1.0, -1.0) * p.turn[use]))
    total = np.zeros(rows)

    def down(k: int, row: np.ndarray, low: np.ndarray, high: np.ndarray, sign: np.ndarray, chosen: list[np.ndarray]) -> None:
        if k == len(upright):
            total[:] += np.bincount(row, sign * _below(low, high, [(upright[i][1][e], upright[i][2][e]) for i, e in enumerate(chosen)], base[row]), rows)
            return
        own, a, b, s = upright[k]
        for i, e in _pairs(row, own, rows):
            x0, x1 = np.maximum(low[i], a[e, 0]), np.minimum(high[i], b[e, 0])
            met = x0 < x1
            i, e = i[met], e[met]
            down(k + 1, row[i], x0[met], x1[met], sign[i] * s[e], [*(c[i] for c in chosen), e])

    row, a, b, sign = upright[0]
    down(1, row, a[:, 0], b[:, 0], sign, [np.arange(len(row))])
    return np.maximum(total, 0.0)


def _below(low: np.ndarray, high: np.ndarray, lines: list[tuple[np.ndarray, np.ndarray]], base: np.ndarray) -> np.ndarray:
    """Integrals from low to high of the lowest of some lines, above base: it is straight between the places where two of them cross."""
    slopes = [(b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0]) for a, b in lines]
    heights = [a[:, 1] - base + s * (low - a[:, 0]) for (a, _), s in zip(lines, slopes, strict=True)]  # at low
    width = high - low
    stops = [np.zeros(len(low)), width]
    for i in range(len(lines)):
        for j in range(i):
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = (heights[i] - heights[j]) / (slopes[j] - slopes[i])
            stops.append(np.clip(np.nan_to_num(cross, nan=0.0, posinf=0.0, neginf=0.0), 0, width))
    at = np.sort(np.stack(stops), axis=0)
    lowest = np.min([h + s * at for h, s in zip(heights, slopes, strict=True)], axis=0)
    return ((at[1:] - at[:-1]) * (lowest[1:] + lowest[:-1])).sum(axis=0) / 2


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0])


def _within(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(axis=1)


def meet(left: Edges, right: Edges) -> np.ndarray:
    """For each row whether the polygons have a point in common; touching counts."""
    found = np.zeros(left.rows, bool)
    for i, j in _pairs(left.row, right.row, left.rows):
        a, b, c, d = left.a[i], left.b[i], right.a[j], right.b[j]
        near = ((np.maximum(a, b) >= np.minimum(c, d)) & (np.maximum(c, d) >= np.minimum(a, b))).all(axis=1)
        i, a, b, c, d = i[near], a[near], b[near], c[near], d[near]
        p, q, r, s = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
        hit = (p * q < 0) & (r * s < 0)
        for side, x, y, z in ((p, a, b, c), (q, a, b, d), (r, c, d, a), (s, c, d, b)):
            hit |= (side == 0) & _within(x, y, z)
        found[left.row[i[hit]]] = True
    for one, other in ((left, right), (right, left)):  # without a common edge point one may lie inside the other: its first point tells
        first = np.full(one.rows, -1)
        first[one.row[::-1]] = np.arange(len(one.row))[::-1]
        has = np.flatnonzero(first >= 0)
        point = np.zeros((one.rows, 2))
        point[has] = one.a[first[has]]
        found |= inside(other, point) & (first >= 0)
    return found


def inside(polygon: Edges, point: np.ndarray) -> np.ndarray:
    """For each row whether its point lies in its polygon, by the even-odd rule."""
    a, b, p = polygon.a, polygon.b, point[polygon.row]
    spans = (a[:, 1] > p[:, 1]) != (b[:, 1] > p[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) / (b[:, 1] - a[:, 1])
    return np.bincount(polygon.row, spans & (p[:, 0] < at), polygon.rows).astype(np.int64) % 2 == 1


def tasks(spark: SparkSession) -> int:
    """For work in Python on rows that few or small partitions hold."""
    return SHARES * spark.sparkContext.defaultParallelism


def _with(df: DataFrame, columns: list[str], name: str, kind: T.DataType, solve) -> DataFrame:
    others = [f for f in df.schema.fields if f.name not in columns]
    schema = T.StructType([*others, T.StructField(name, kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = solve([batch.column(c) for c in columns])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), value if isinstance(value, pa.Array) else pa.array(value)], names=schema.names)

    return df.mapInArrow(work, schema)


def with_shared_area(df: DataFrame, columns: list[str], name: str = "area") -> DataFrame:
    """df without the polygon columns (two or more), and the area that all of them share."""
    return _with(df, columns, name, T.DoubleType(), lambda c: shared_areas([edges(x) for x in c]))


def with_meeting(df: DataFrame, left: str, right: str, name: str = "meets") -> DataFrame:
    return _with(df, [left, right], name, T.BooleanType(), lambda c: meet(edges(c[0]), edges(c[1])))


def with_containment(df: DataFrame, outer: str, inner: str, name: str = "contains") -> DataFrame:
    """Whether outer covers all of inner, to one part in 1,000,000,000 of inner's area; never if inner has no area."""

    def solve(c: list[pa.Array]) -> np.ndarray:
        a, b = edges(c[0]), edges(c[1])
        own = b.area()
        return (own > 0) & (own - shared_areas([a, b]) <= TINY * own)

    return _with(df, [outer, inner], name, T.BooleanType(), solve)


# repair


def faces(rings: list[list[list[float]]]) -> list[list[list[list[float]]]]:
    """The polygons whose inside has an odd number of the given closed rings around it."""
    ends = np.cumsum([0, *map(len, rings)])
    point = np.array([p for r in rings for p in r], float).reshape(-1, 2)
    return _faces(point, ends, np.array([0, len(rings)]))[0]


def _faces(point: np.ndarray, ring: np.ndarray, polygon: np.ndarray) -> list[list[list[list[list[float]]]]]:
    """Of each row the polygons whose inside has an odd number of its rings around it: edges are cut where they cross, edges that lie
    twice go, those with the inside on one side only stay, and rings are traced with the inside on the left, turning left wherever
    rings touch. ring and polygon: where the points of a ring, and the rings of a row, end. All but the tracing is done for all rows at once."""
    rows = len(polygon) - 1
    of_ring = np.repeat(np.arange(len(ring) - 1), np.diff(ring))
    after = np.arange(1, len(point) + 1)
    full = np.diff(ring) > 0
    after[ring[1:][full] - 1] = ring[:-1][full]  # a ring that isn't closed gets the edge that it lacks
    a, b = point, point[after]
    unlike = (a != b).any(axis=1)
    row, a, b = _cut_edges(np.repeat(np.arange(rows), np.diff(polygon))[of_ring][unlike], a[unlike], b[unlike], rows)
    swap = ((a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])))[:, None]
    p, q = np.where(swap, b, a) + 0.0, np.where(swap, a, b) + 0.0  # -0 is 0
    order = np.lexsort((q[:, 1], q[:, 0], p[:, 1], p[:, 0], row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (p[order][1:] != p[order][:-1]).any(axis=1) | (q[order][1:] != q[order][:-1]).any(axis=1)
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    kept = np.sort(order[new][times % 2 == 1])
    row, p, q = row[kept], p[kept], q[kept]
    middle, along = (p + q) / 2, q - p
    steep = np.abs(along[:, 1]) >= np.abs(along[:, 0])
    # how many edges lie strictly to the left of the middle, along a line across: odd means that the inside is on the left
    beyond = np.zeros(len(p), np.int64)
    for i, j in _pairs(row, row, rows):
        u = steep[i].astype(np.int64)  # a ray along 1 - u, at height u of the middle
        spans = ((p[j, u] > middle[i, u]) != (q[j, u] > middle[i, u])) & (i != j)
        i, j, u = i[spans], j[spans], u[spans]
        at = p[j, 1 - u] + (q[j, 1 - u] - p[j, 1 - u]) * (middle[i, u] - p[j, u]) / (q[j, u] - p[j, u])
        beyond += np.bincount(i, at < middle[i, 1 - u], len(p)).astype(np.int64)  # the inside lies at smaller values
    flip = ((beyond % 2 == 1) != np.where(steep, along[:, 1] > 0, along[:, 0] < 0))[:, None]
    start, end = np.where(flip, q, p).tolist(), np.where(flip, p, q).tolist()
    first = np.searchsorted(row, np.arange(rows + 1)).tolist()
    return [_traced(start[i:j], end[i:j]) for i, j in zip(first, first[1:], strict=False)]


def _traced(start: list[list[float]], end: list[list[float]]) -> list[list[list[list[float]]]]:
    """Polygons of edges with the inside on the left."""
    leaving: dict[tuple, list[int]] = {}
    for i, x in enumerate(map(tuple, start)):
        leaving.setdefault(x, []).append(i)
    used = [False] * len(start)
    found = []
    for first in range(len(start)):
        if used[first]:
            continue
        ring, at = [start[first]], first
        while True:
            used[at] = True
            ring.append(end[at])
            if ring[-1] == ring[0]:
                break
            options = [i for i in leaving[tuple(end[at])] if not used[i]]
            if len(options) > 1:
                way = _angle(start[at], end[at])
                at = max(options, key=lambda i: (_angle(start[i], end[i]) - way + math.pi) % (2 * math.pi))  # noqa: B023
            else:
                (at,) = options
        found += map(_straight, _loops(ring))
    return _nested([r for r in found if len(r) >= 4])


def _angle(a: list[float], b: list[float]) -> float:
    return math.atan2(b[1] - a[1], b[0] - a[0])


def _loops(ring: list[list[float]]) -> list[list[list[float]]]:
    """A ring that touches itself, as rings that don't."""
    out, path, place = [], [], {}
    for p in ring:
        if tuple(p) in place:
            k = place[tuple(p)]
            out.append([*path[k:], p])
            for x in path[k + 1 :]:
                del place[tuple(x)]
            del path[k + 1 :]
        else:
            place[tuple(p)] = len(path)
            path.append(p)
    return out


def _cut_edges(row: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (row of each, in order, and ends), cut where another one of their row meets them; pieces in the order of edges, then along them."""
    found = [(np.zeros(0, np.int64), np.zeros((0, 2)))]
    for i, j in _pairs(row, row, rows):
        near = ((np.maximum(a[j], b[j]) >= np.minimum(a[i], b[i])) & (np.maximum(a[i], b[i]) >= np.minimum(a[j], b[j]))).all(axis=1) & (i != j)
        i, j = i[near], j[near]
        d, e, away = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (away[:, 0] * e[:, 1] - away[:, 1] * e[:, 0]) / cross
            u = (away[:, 0] * d[:, 1] - away[:, 1] * d[:, 0]) / cross
        hit = (cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        at = lambda x: x[hit][:, None]  # noqa: B023, E731
        # the same point for both edges: an end where there is one, else worked out from the edge that comes first
        point = np.where(at(i < j), a[i[hit]] + at(t) * d[hit], a[j[hit]] + at(u) * e[hit])
        found.append((i[hit], np.where(at(u) == 0, a[j[hit]], np.where(at(u) == 1, b[j[hit]], point))))
        line = i[cross == 0]
        for x in (a[j[cross == 0]], b[j[cross == 0]]):  # ends of edges on the same line
            on = (_side(a[line], b[line], x) == 0) & _within(a[line], b[line], x)
            found.append((line[on], x[on]))
    n = np.arange(len(a))
    cut, points = (np.concatenate(x) for x in zip(*found, strict=True))
    edge, stop = np.concatenate([n, cut, n]), np.concatenate([a, points, b])
    place = np.repeat([0, 1, 2], [len(a), len(cut), len(a)])
    order = np.lexsort((((stop - a[edge]) * (b - a)[edge]).sum(axis=1), place, edge))
    edge, stop = edge[order], stop[order]
    piece = np.flatnonzero((edge[1:] == edge[:-1]) & (stop[1:] != stop[:-1]).any(axis=1))
    return row[edge[piece]], stop[piece], stop[piece + 1]


def _straight(ring: list[list[float]]) -> list[list[float]]:
    """Without points in the middle of straight sides."""
    points = ring[:-1]
    turn = lambda i: (points[i][0] - points[i - 1][0]) * (points[(i + 1) % len(points)][1] - points[i][1]) - (points[i][1] - points[i - 1][1]) * (points[(i + 1) % len(points)][0] - points[i][0])
    kept = [p for i, p in enumerate(points) if turn(i) != 0]
    return [*kept, kept[0]] if kept else []


def _nested(rings: list[list[list[float]]]) -> list[list[list[list[float]]]]:
    """Polygons of outer rings (against the clock) and the holes in them, the smallest outer ring around a hole first."""
    size = [sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False)) / 2 for r in rings]
    outer = sorted((i for i in range(len(rings)) if size[i] > 0), key=lambda i: size[i])
    polygons = {i: [rings[i]] for i in outer}
    for h in (i for i in range(len(rings)) if size[i] <= 0):
        x, y = ((rings[h][0][k] + rings[h][1][k]) / 2 for k in (0, 1))
        for i in outer:
            crossings = sum((p[1] > y) != (q[1] > y) and x < p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) for p, q in zip(rings[i], rings[i][1:], strict=False))
            if crossings % 2 and size[i] > -size[h]:
                polygons[i].append(rings[h])
                break
    return [polygons[i] for i in sorted(outer)]


def repaired(df: DataFrame, column: str = "rings", name: str = "polygons") -> DataFrame:
    """df with polygons in the place of the rings, whatever crosses in them; null stays null, and rings without an area give none.
    Rows are dealt out to all cores first, as a small file can hold many."""

    def solve(c: list[pa.Array]) -> pa.Array:
        rings = c[0].flatten()
        point = np.asarray(rings.flatten().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 2)
        rows = _faces(point, _ends(rings), _ends(c[0]))
        kind = pa.float64()
        for _ in range(4):
            kind = pa.list_(kind)
        return pa.array([x if there else None for x, there in zip(rows, c[0].is_valid().to_pylist(), strict=True)], kind)

    return _with(df.repartition(tasks(df.sparkSession)), [column], name, POLYGONS, solve)
