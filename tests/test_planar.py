"""Polygons against polygons: areas against triangles clipped one by one, predicates and repair against hand-made and random shapes."""

import math
import random

import pytest

from loamgrid.operators import planar

SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]
FRAME = [SQUARE[0], [[2.0, 2.0], [8.0, 2.0], [8.0, 8.0], [2.0, 8.0], [2.0, 2.0]]]
BOW = [[[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]]
KIND = "a array<array<array<double>>>, b array<array<array<double>>>, c array<array<array<double>>>, k int"


def signed(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2


def clipped(triangle, other):
    """Sutherland-Hodgman of two triangles that run against the clock."""
    for a, b in zip(other, other[1:] + other[:1], strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        out = []
        for p, q in zip(triangle, triangle[1:] + triangle[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if (s > 0 > t) or (s < 0 < t):
                out.append([p[k] + s / (s - t) * (q[k] - p[k]) for k in (0, 1)])
        triangle = out
        if not triangle:
            return []
    return triangle


def fans(rings):
    """Signed triangles of a polygon."""
    for k, ring in enumerate(rings):
        turn = 1 if (signed(ring) > 0) == (k == 0) else -1
        for p, q in zip(ring[1:], ring[2:], strict=False):
            t = [ring[0], p, q]
            s = signed([*t, t[0]])
            yield (t if s > 0 else t[::-1]), turn * (s > 0) - turn * (s < 0)


def shared(*polygons):
    near = [[[[p[0] - 600_000, p[1] - 5_500_000] for p in ring] for ring in rings] for rings in polygons]
    parts = list(fans(near[0]))
    for rings in near[1:]:
        new = []
        for part, s in parts:
            for t, u in fans(rings):
                if u and (cut := clipped(part, t)):
                    new.append((cut, s * u))
        parts = new
    return sum(s * signed([*p, p[0]]) for p, s in parts)


def star(r, n, x, y, size, backwards=False):
    points = [[x + size * m * math.cos(t), y + size * m * math.sin(t)] for t, m in ((2 * math.pi * i / n, r.uniform(0.3, 1)) for i in range(n))]
    points = points[::-1] if backwards else points
    return [*points, points[0]]


def shapes(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = 600_000 + r.uniform(0, 8), 5_500_000 + r.uniform(0, 8)
        rings = [star(r, r.randrange(3, 12), x, y, 6, r.random() < 0.5)]
        if r.random() < 0.5:
            rings.append([[x + 0.1 * (p[0] - x), y + 0.1 * (p[1] - y)] for p in rings[0]])
        out.append(rings)
    return out


def test_shared_areas_of_two_and_three(spark, monkeypatch):
    monkeypatch.setattr(planar, "CHUNK", 50)
    a, b, c = (shapes(s, 60) for s in (1, 2, 3))
    a[0], a[1], b[1], c[1] = FRAME, SQUARE, FRAME, SQUARE
    a[2] = None
    rows = [(*x, i) for i, x in enumerate(zip(a, b, c, strict=True))]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    two = {x["k"]: x["area"] for x in planar.with_shared_area(table.select("k", "a", "b"), ["a", "b"]).collect()}
    three = {x["k"]: x["area"] for x in planar.with_shared_area(table, ["a", "b", "c"]).collect()}
    assert two[1] == pytest.approx(64) and three[1] == pytest.approx(64) and two[2] == three[2] == 0
    for p, q, s, k in rows[3:]:
        assert two[k] == pytest.approx(shared(p, q), abs=1e-6)
        assert three[k] == pytest.approx(shared(p, q, s), abs=1e-6)
    assert sum(v > 1 for v in three.values()) > 20


def box(x0, y0, x1, y1):
    return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]


@pytest.mark.parametrize(
    "left, right, meets, contains",
    [
        (SQUARE, box(2.0, 2.0, 3.0, 3.0), True, True), (FRAME, box(3.0, 3.0, 4.0, 4.0), False, False), (FRAME, box(0.0, 0.0, 1.0, 2.0), True, True), (FRAME, box(1.0, 1.0, 3.0, 3.0), True, False),
        (SQUARE, box(10.0, 3.0, 12.0, 4.0), True, False), (SQUARE, box(10.0, 10.0, 11.0, 11.0), True, False), (SQUARE, box(10.5, 0.0, 11.0, 1.0), False, False), (box(2.0, 2.0, 3.0, 3.0), SQUARE, True, False),
        (SQUARE, SQUARE, True, True), (None, SQUARE, False, False), (FRAME, box(2.0, 2.0, 8.0, 8.0), True, False), (SQUARE, [], False, False),
    ],
)
def test_meeting_and_containment(spark, left, right, meets, contains):
    table = spark.createDataFrame([(left, right, None, 0)], KIND)
    assert planar.with_meeting(table, "a", "b").first()["meets"] == meets
    assert planar.with_containment(table, "a", "b").first()["contains"] == contains


def areas(polygons):
    return sorted(round(abs(signed(p[0])) - sum(abs(signed(h)) for h in p[1:]), 6) for p in polygons)


def test_repair(spark):
    pentagram = [[[math.cos(2.4 * math.pi * i / 3), math.sin(2.4 * math.pi * i / 3)] for i in range(5)]]
    pentagram[0].append(pentagram[0][0])
    touching = [SQUARE[0], [[0.0, 5.0], [3.0, 4.0], [3.0, 6.0], [0.0, 5.0]]]
    spike = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [4.0, 9.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
    given = {"square": SQUARE, "frame": FRAME, "bow": BOW, "star": pentagram, "touching": touching, "spike": spike, "open": [SQUARE[0][:-1]], "line": [[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], "null": None}
    table = spark.createDataFrame([(k, v) for k, v in given.items()], "k string, rings array<array<array<double>>>")
    got = {x["k"]: x["polygons"] for x in planar.repaired(table).collect()}
    assert [len(got[k]) for k in ("square", "frame", "bow", "star", "touching", "spike", "open", "line")] == [1, 1, 2, 5, 1, 1, 1, 0]
    assert got["null"] is None and [len(p) for p in got["frame"]] == [2] and [len(p) for p in got["touching"]] == [2]
    for k, n in (("square", [100.0]), ("frame", [64.0]), ("bow", [1.0, 1.0]), ("touching", [97.0]), ("spike", [16.0]), ("open", [100.0])):
        assert areas(got[k]) == n
    assert {tuple(p) for p in got["square"][0][0]} == {tuple(p) for p in SQUARE[0]} and len(got["square"][0][0]) == 5


def test_repair_of_random_rings_keeps_the_even_odd_inside():
    r = random.Random(9)
    for _ in range(150):
        points = [[float(r.randrange(9)), float(r.randrange(9))] if r.random() < 0.5 else [r.uniform(0, 8), r.uniform(0, 8)] for _ in range(r.randrange(3, 9))]
        ring = [*points, points[0]]
        polygons = planar.faces([ring])
        odd = lambda rings, x, y: sum((p[1] > y) != (q[1] > y) and x < p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) for t in rings for p, q in zip(t, t[1:], strict=False)) % 2
        for _ in range(60):
            x, y = r.uniform(0, 8), r.uniform(0, 8)
            assert odd([ring], x, y) == sum(odd(p, x, y) for p in polygons)
        for polygon in polygons:
            assert signed(polygon[0]) > 0 and all(signed(h) < 0 for h in polygon[1:])
            assert all(len({tuple(p) for p in t}) == len(t) - 1 for t in polygon)
