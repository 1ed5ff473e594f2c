"""Paged features from a folder of pages, and kernels against a plain version for each pixel."""

import json
import math
import random

import pytest
from pyspark.sql.types import DoubleType, StructField, StructType

from loamgrid.operators import resample
from loamgrid.sources import pages


def written(folder, features, page):
    for k in range(0, len(features) + 1, page):
        (folder / f"{k // page}.json").write_text(json.dumps({"type": "FeatureCollection", "features": features[k : k + page]}))
    for k in range(len(features) // page + 1, len(features) // page + 9):
        (folder / f"{k}.json").write_text(json.dumps({"features": []}))
    return f"file://{folder}/{{page}}.json"


def square(i):
    return [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]]


@pytest.fixture
def features():
    single = [{"properties": {"ID": i, "Code": f"c{i}", "more": 1}, "geometry": {"type": "Polygon", "coordinates": square(i)}} for i in range(23)]
    return [*single, {"properties": {"ID": 99}, "geometry": {"type": "MultiPolygon", "coordinates": [square(50), square(60)]}}, {"properties": None, "geometry": None}]


@pytest.mark.parametrize("page, readers", [(5, 4), (7, 2), (100, 3), (25, 1)])
def test_every_feature_of_every_page_once(spark, tmp_path, features, page, readers):
    pages.register(spark)
    load = lambda address: spark.read.format("feature_pages").option("address", address).option("fields", "ID bigint, Code string").option("page", page).option("readers", readers).load()
    table = load(written(tmp_path, features, page))
    assert table.columns == ["id", "code", "rings", "x0", "y0", "x1", "y1"]
    rows = table.collect()
    assert sorted((x["id"], x["code"], x["x0"]) for x in rows if x["id"] < 99) == [(i, f"c{i}", float(i)) for i in range(23)]
    assert sorted(x["x0"] for x in rows if x["id"] == 99) == [50.0, 60.0] and len(rows) == 25
    some = table.where("x1 >= 3 and x0 <= 5 and id > 2")
    assert sorted(x["id"] for x in some.collect()) == [3, 4, 5]


def test_the_envelope_is_asked_for():
    reader = pages.PageReader(StructType([StructField(c, DoubleType()) for c in ("a", "rings", *pages.BOX)]), {"address": ""})
    filters = [pages.GreaterThanOrEqual(("x1",), 3.0), pages.GreaterThan(("x1",), 2.0), pages.LessThan(("y0",), 9.0), pages.LessThan(("a",), 1)]
    assert list(reader.pushFilters(filters)) == filters and reader.envelope() == "3.0,-inf,inf,9.0"


@pytest.mark.parametrize("answer, said", [({"error": "busy"}, "busy"), ({"features": []}, "no feature"), ({"rows": []}, "something else")])
def test_answers_that_are_errors(spark, tmp_path, answer, said):
    pages.register(spark)
    (tmp_path / "0.json").write_text(json.dumps(answer))
    with pytest.raises(Exception, match=said):
        spark.read.format("feature_pages").option("address", f"file://{tmp_path}/{{page}}.json").option("fields", "a int").option("readers", 1).load().collect()


def plain(grid, shape, at, kernel, step):
    """One destination pixel; grid: values by (r, c)."""
    y, x = at
    near = (math.floor(y), math.floor(x))
    if not (0 <= y < shape[0] and 0 <= x < shape[1]) or near not in grid:
        return None
    if kernel == "nearest":
        return grid[near]
    weigh = {"bilinear": lambda d: max(0.0, 1 - abs(d)), "cubic": lambda d: 1.5 * abs(d) ** 3 - 2.5 * d * d + 1 if abs(d) < 1 else -0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2 if abs(d) < 2 else 0.0}[kernel]
    w = {k: weigh((k[0] + 0.5 - y) / max(1, step[0])) * weigh((k[1] + 0.5 - x) / max(1, step[1])) for k in grid}
    total = sum(w.values())
    return sum(grid[k] * v for k, v in w.items()) / total if total > 0 else None


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("origin, step", [((0.0, 0.0), (0.5, 0.5)), ((-1.3, 2.2), (0.7, 1.6)), ((0.25, 0.0), (2.5, 0.9))])
def test_kernels_match_a_plain_version(spark, kernel, origin, step):
    r = random.Random(7)
    grid = {(i, j): r.uniform(0, 100) for i in range(13) for j in range(17) if r.random() > 0.15}
    rows = [(i, j, v) for (i, j), v in grid.items()] + [(0, 40, None), (1, 41, float("nan"))]
    table = spark.createDataFrame(rows, "r int, c int, b double").repartition(2)
    got = {(x["r"], x["c"]): x["value"] for x in resample.resample(table, "b", 20, 15, (13, 17), kernel, origin, step, tile=6).collect()}
    want = {(i, j): plain(grid, (13, 17), (origin[0] + (i + 0.5) * step[0], origin[1] + (j + 0.5) * step[1]), kernel, step) for i in range(20) for j in range(15)}
    assert got == pytest.approx({k: v for k, v in want.items() if v is not None}, rel=1e-9, abs=1e-9)
