"""Scanlines against point in polygon for each pixel, and outlines against the pixels and edges that they enclose."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import polygons, regions, scanline
from tests.test_planar import shapes, signed
from tests.test_regions import FOUR, flood


def test_scanlines_match_point_in_polygon_for_each_pixel(spark):
    moved = [[[[p[0] - 599_990, p[1] - 5_499_990] for p in ring] for ring in rings] for rings in shapes(4, 12)]
    moved += [[[[2.5, 2.5], [6.5, 2.5], [6.5, 6.5], [2.5, 6.5], [2.5, 2.5]], [[3.5, 3.5], [3.5, 5.5], [5.5, 5.5], [5.5, 3.5], [3.5, 3.5]]], [[[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]], [], None]
    table = spark.createDataFrame([(i, i % 3, float(i % 5), x) for i, x in enumerate(moved)], "id int, kind int, area double, rings array<array<array<double>>>")
    grid = spark.range(30).select(F.col("id").alias("r")).crossJoin(spark.range(30).select(F.col("id").alias("c")))
    each = table.withColumnRenamed("rings", "g").crossJoin(grid).where(polygons.contains(F.col("g"), F.col("c") + 0.5, F.col("r") + 0.5))
    want = {(x["id"], x["r"], x["c"]) for x in each.collect()}
    got = [(x["id"], x["r"], x["c"]) for x in scanline.pixels(table, ["id"], 1.0).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    first: dict = {}
    for i, r, c in want:
        first[r, c] = min(first.get((r, c), (9, 99)), (i % 5, i))
    assert {(x["r"], x["c"]): x["kind"] for x in scanline.rasterise(table, "kind", ["area", "id"], 1.0).collect()} == {k: i % 3 for k, (_, i) in first.items()}
    assert scanline.pixels(table.limit(0), ["id"], 1.0).count() == 0


@pytest.mark.parametrize("masked", [0.0, 0.3])
def test_outlines_enclose_their_pixels(spark, masked):
    r = random.Random(3)
    label = {(i, j): r.choice([1, 1, 2]) for i in range(14) for j in range(16) if r.random() >= masked}
    if not masked:
        label |= {(i, j): 1 + (3 <= i <= 8 and 3 <= j <= 8) - (5 <= i <= 6 and 5 <= j <= 6) for i in range(1, 11) for j in range(1, 11)}
    table = spark.createDataFrame([(i, j, v) for (i, j), v in label.items()], "r int, c int, label int").repartition(3)
    rows = regions.outlines(table, 5).collect()
    found = flood(label, FOUR)
    sizes: dict = {}
    sides: dict = {}
    for (i, j), top in found.items():
        sizes[top] = sizes.get(top, 0) + 1
        sides[top] = sides.get(top, 0) + sum(found.get((i + a, j + b)) != top for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    area: dict = {}
    length: dict = {}
    outer: dict = {}
    for x in rows:
        top = (x["component"] >> 32, x["component"] & 0xFFFFFFFF)
        assert x["label"] == label[top]
        ring = [(p["c"], -p["r"]) for p in x["points"]]
        ring.append(ring[0])
        assert signed(ring) == x["signed"]
        assert all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(ring, ring[1:], strict=False))  # corners follow each other along rows and columns
        assert sum(abs(p[0] - q[0]) + abs(p[1] - q[1]) for p, q in zip(ring, ring[1:], strict=False)) == x["size"]
        area[top] = area.get(top, 0) + x["signed"]
        length[top] = length.get(top, 0) + x["size"]
        outer[top] = outer.get(top, 0) + (x["signed"] > 0)
    assert area == sizes and length == sides
    assert set(outer.values()) == {1}
    assert regions.outlines(table.limit(0)).count() == 0
