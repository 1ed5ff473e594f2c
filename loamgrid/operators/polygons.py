"""Polygons as arrays of rings (the outer one first, then holes), each a closed array of points [x, y], with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def edges(ring: Column) -> Column:
    """Pairs of points that follow each other."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b"))


def signed_area(ring: Column) -> Column:
    """Shoelace, about the first point; positive if the ring runs against the clock."""
    x0, y0 = ring[0][0], ring[0][1]
    part = lambda e: (e["a"][0] - x0) * (e["b"][1] - y0) - (e["b"][0] - x0) * (e["a"][1] - y0)
    return F.aggregate(edges(ring), F.lit(0.0), lambda t, e: t + part(e)) / 2


def area(rings: Column) -> Column:
    """The outer ring's area without the holes'."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.aggregate(F.slice(sizes, F.lit(2), F.greatest(F.size(sizes) - 1, F.lit(0))), sizes[0], lambda t, x: t - x)


def perimeter(rings: Column) -> Column:
    length = lambda e: F.hypot(e["b"][0] - e["a"][0], e["b"][1] - e["a"][1])
    return F.aggregate(rings, F.lit(0.0), lambda t, r: t + F.aggregate(edges(r), F.lit(0.0), lambda u, e: u + length(e)))


def compactness(rings: Column) -> Column:
    """Polsby-Popper; null without a perimeter."""
    p = perimeter(rings)
    return F.when(p > 0, 4 * F.pi() * area(rings) / (p * p))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the even-odd rule; points on a left or lower edge count as inside."""
    crossed = lambda e: ((e["a"][1] > y) != (e["b"][1] > y)) & (x < (e["b"][0] - e["a"][0]) * (y - e["a"][1]) / (e["b"][1] - e["a"][1]) + e["a"][0])
    times = F.aggregate(rings, F.lit(0), lambda t, r: t + F.size(F.filter(edges(r), crossed)))
    return times % 2 == 1


def clip(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a ring inside a box, as one closed ring (Sutherland-Hodgman); empty if nothing is left."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        ring = named(ring, _halving(axis, bound, sign))
    return ring


def _halving(axis: int, bound: Column, sign: int) -> Callable[[Column], Column]:
    return lambda ring: _half(ring, axis, bound, sign)


def _half(ring: Column, axis: int, bound: Column, sign: int) -> Column:
    inside = lambda p: (p[axis] - bound) * sign >= 0

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        share = (bound - a[axis]) / (b[axis] - a[axis])
        point = F.array(a[0] + share * (b[0] - a[0]), a[1] + share * (b[1] - a[1]))
        none = F.array().cast("array<array<double>>")
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(point)).when(inside(b), F.array(point, b)).otherwise(none)

    return named(F.flatten(F.transform(edges(ring), cut)), lambda points: F.when(F.size(points) > 0, F.concat(points, F.slice(points, 1, 1))).otherwise(points))


def is_valid(ring: Column) -> Column:
    """Closed, of four points at least, and no two edges that cross."""
    side = lambda p, q, r: F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    cross = lambda s, t: (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)
    crossing = named(edges(ring), lambda e: F.exists(e, lambda s: F.exists(e, lambda t: cross(s, t))))
    return (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)) & ~crossing
