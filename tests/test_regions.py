"""Components in tiles against a flood fill, on masked grids and far-off columns."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import raster, regions
from loamgrid.plans import sweep

FOUR, EIGHT = ((0, 1), (1, 0)), ((0, 1), (1, 0), (1, 1), (1, -1))


def flood(label, steps):
    found: dict = {}
    for start in sorted(label):
        todo = [start]
        while todo:
            i, j = at = todo.pop()
            if at not in found:
                found[at] = start
                todo += [x for a, b in steps for x in ((i + a, j + b), (i - a, j - b)) if x in label and label[x] == label[at] and x not in found]
    return found


def solved(spark, label, steps, tile):
    table = spark.createDataFrame([(i, j, v) for (i, j), v in label.items()], "r int, c int, label int").repartition(3)
    return {(x["r"], x["c"]): (x["component"] >> 32, x["component"] & 0xFFFFFFFF) for x in regions.components(table, steps, tile).collect()}


@pytest.mark.parametrize("steps, tile, masked, low", [(FOUR, 512, 0.0, 0), (EIGHT, 5, 0.0, 0), (FOUR, 4, 0.3, 999_995), (EIGHT, 3, 0.4, 2_000_000)])
def test_components_match_a_flood_fill(spark, steps, tile, masked, low):
    r = random.Random(tile)
    label = {(i, low + j): r.choice([1, 2, None]) if masked else r.randrange(2) for i in range(14) for j in range(17) if r.random() >= masked}
    assert solved(spark, label, steps, tile) == flood(label, steps)


def test_a_snake_through_all_tiles_is_one_region(spark):
    label = {(i, j): 1 if i % 2 == 0 or j == (0 if i % 4 == 1 else 19) else 2 for i in range(20) for j in range(20)}
    assert solved(spark, label, FOUR, 4) == flood(label, FOUR)


def test_gaps_part_regions_and_edges(spark):
    table = spark.createDataFrame([(0, 0, 1), (0, 2, 1), (0, 3, 2), (5, 2, 3)], "r int, c int, label int")
    assert regions.components(table).select("component").distinct().count() == 4
    assert {(x["r"], x["c"]): x["edge"] for x in raster.boundary(table).collect()} == {(0, 0): False, (0, 2): True, (0, 3): True, (5, 2): False}
    assert regions.components(table.limit(0)).count() == 0


def test_evaluation_counts_the_regions_of_masked_maps(spark):
    r = random.Random(8)
    maps = {t: {(i, j): r.choice([0, 0, 1, 2]) for i in range(15) for j in range(40)} for t in (0.5, 2.0)}
    table = spark.createDataFrame([(t, i, j, v) for t, m in maps.items() for (i, j), v in m.items()], "theta double, r int, c int, label int")
    got = {x["theta"]: (x["polygons"], x["dropped"], round(x["dropped_km2"], 9)) for x in sweep.evaluate(table, table.where("theta = 2.0").select("r", "c", F.col("label").alias("truth")), table.where("theta = 2.0 and label = 1").select("r", "c")).collect()}
    for t, m in maps.items():
        found = list(flood({k: v for k, v in m.items() if v}, FOUR).values())
        areas = [100 * found.count(x) for x in set(found)]
        small = [a for a in areas if a < 2000]
        assert got[t] == (len(areas) - len(small), len(small), round(sum(small) / 1e6, 9))
