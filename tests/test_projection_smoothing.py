"""Projections against known points, tiled smoothing against the whole grid, simplification, and what sinks write."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import projection
from loamgrid.operators import simplify, smoothing
from loamgrid.plans import sweep
from loamgrid.sources import sinks


def row(spark, sql):
    return spark.sql(sql.replace("//", " div ")).first()


def test_projections_hit_known_points(spark):
    """The origin of the European grid, a zone's central meridian (meridian arc of 45 degrees), and the way there and back."""
    r = row(spark, projection.to_laea("SELECT 10.0D AS lon, 52.0D AS lat", ["lon"], "lon", "lat"))
    assert (round(r["east"], 4), round(r["north"], 4)) == (4321000, 3210000)
    r = row(spark, projection.to_laea("SELECT 5.0D AS lon, 50.0D AS lat", ["lon"], "lon", "lat"))
    assert r["east"] == pytest.approx(3962799.45, abs=0.01) and r["north"] == pytest.approx(2999718.85, abs=0.01)
    r = row(spark, projection.to_utm("SELECT 9.0D AS lon, 45.0D AS lat", ["lon"], "lon", "lat", 32))
    assert r["east"] == pytest.approx(500000, abs=1e-6) and r["north"] == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    r = row(spark, projection.to_mercator("SELECT 180.0D AS lon, 0.0D AS lat", ["lat"], "lon", "lat"))
    assert r["mx"] == pytest.approx(20037508.342789, abs=1e-5) and abs(r["my"]) < 1e-6
    points = "SELECT id AS k, 4.0D + id AS x, 47.0D + id / 2 AS y FROM range(8)"
    for there, back in (
        (projection.to_utm(points, ["k", "x", "y"], "x", "y", 32), lambda t: projection.from_utm(t, ["k", "x", "y"], "east", "north", 32)),
        (projection.to_laea(points, ["k", "x", "y"], "x", "y"), lambda t: projection.from_laea(t, ["k", "x", "y"], "east", "north")),
        (projection.to_mercator(points, ["k", "x", "y"], "x", "y"), lambda t: projection.from_mercator(t, ["k", "x", "y"], "mx", "my")),
    ):
        for r in spark.sql(back(there)).collect():
            assert r["lon"] == pytest.approx(r["x"], abs=1e-8) and r["lat"] == pytest.approx(r["y"], abs=1e-8)


def test_outline_walks_around_the_box(spark):
    points = spark.sql(projection.outline("SELECT 0.0D AS x0, 0.0D AS y0, 4.0D AS x1, 2.0D AS y1", ["x0"], 4).replace("//", " div ")).collect()
    assert len({(p["x"], p["y"]) for p in points}) == 16
    assert all(p["x"] in (0, 4) or p["y"] in (0, 2) for p in points)


def scene(spark, h=23, w=31, seed=2):
    r = np.random.default_rng(seed)
    p = r.dirichlet(np.ones(3), (h, w))
    f = r.normal(size=(h, w, 2))
    valid = r.random((h, w)) < 0.9
    rows = pd.DataFrame([(i, k, bool(valid[i, k]), *map(float, p[i, k]), *map(float, f[i, k])) for i in range(h) for k in range(w)], columns=["r", "c", "valid", "p0", "p1", "p2", "f0", "f1"])
    return p, f, valid, spark.createDataFrame(rows, "r int, c int, valid boolean, p0 double, p1 double, p2 double, f0 double, f1 double")


@pytest.mark.parametrize("sigma", [0.7, None])
def test_tiles_smooth_as_the_whole_grid_does(spark, sigma):
    p, f, valid, pixels = scene(spark)
    h, w = valid.shape
    q, changes = np.where(valid[..., None], p, 0), []
    for _ in range(3):
        new = np.zeros_like(q)
        for i in range(h):
            for k in range(w):
                if not valid[i, k]:
                    continue
                score = np.log(np.clip(p[i, k], 1e-6, 1))
                for a in (i - 1, i, i + 1):
                    for b in (k - 1, k, k + 1):
                        if (a, b) != (i, k) and 0 <= a < h and 0 <= b < w and valid[a, b]:
                            like = 1 if sigma is None else math.exp(-((f[i, k] - f[a, b]) ** 2).sum() / (2 * sigma**2))
                            score = score + 1.5 * like / math.hypot(a - i, b - k) * q[a, b]
                new[i, k] = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        changes.append(np.abs(new - q)[valid].mean())
        q = new
    got = smoothing.smooth(pixels, [0.0, 1.5], sigma, 3, 3, 2, tile=8)
    rows = got.collect()
    assert len(rows) == 2 * h * w
    for x in rows:
        want = q[x["r"], x["c"]] if x["theta"] else np.where(valid[x["r"], x["c"]], p[x["r"], x["c"]], 0)
        assert np.allclose(x["q"], want, atol=1e-9)
    steps = {x["step"]: x["change"] for x in smoothing.convergence(got.where("theta > 0"), 3).collect()}
    assert np.allclose([steps[k] for k in range(3)], changes)


def test_empty_scene_and_classes(spark):
    pixels = scene(spark)[3].limit(0)
    assert smoothing.smooth(pixels, [1.0], 1.0, 2, 3, 2).count() == 0
    got = spark.sql("SELECT array(0.2D, 0.4D, 0.4D) AS q UNION ALL SELECT array(0.0D, 0.0D, 0.0D)").select(smoothing.decoded(F.col("q"), (1, 2, 4)).alias("k")).collect()
    assert [x["k"] for x in got] == [2, 0]


@pytest.mark.parametrize(("rows", "want"), [([(0.3, 0.9, 5.0), (0.8, 0.8, 3.0), (2.0, 0.7, 1.0)], 0.8), ([(0.3, 0.9, 3.0), (0.8, 0.8, 3.0)], 0.3), ([(0.3, 0.1, 9.0), (0.8, 0.2, 3.0)], 0.3)])
def test_choice_of_theta(spark, rows, want):
    assert smoothing.chosen(spark.createDataFrame(rows, "theta double, retention double, dropped_km2 double")).first()["theta"] == want


def test_evaluation_of_maps(spark):
    """Two maps of 6 x 8 pixels: regions by hand."""
    first = [[1 if c < 5 else 2 for c in range(8)] for r in range(6)]  # 30 and 18 pixels
    second = [[1 if (r, c) == (2, 6) else x for c, x in enumerate(row)] for r, row in enumerate(first)]
    maps = spark.createDataFrame([(t, r, c, m[r][c]) for t, m in ((0.5, first), (1.0, second)) for r in range(6) for c in range(8)], "theta double, r int, c int, label int")
    truth = spark.createDataFrame([(r, c, first[r][c] if r else 0) for r in range(6) for c in range(8)], "r int, c int, truth int")
    thin = spark.createDataFrame([(2, 6), (2, 0)], "r int, c int")
    got = {x["theta"]: x for x in sweep.evaluate(maps, truth, thin).collect()}
    assert [(got[t]["pixels"], got[t]["accuracy"], got[t]["retention"], got[t]["polygons"], got[t]["dropped"]) for t in (0.5, 1.0)] == [(40, 1.0, 0.5, 1, 1), (40, 39 / 40, 1.0, 1, 2)]
    assert got[0.5]["dropped_km2"] == pytest.approx(0.0018) and got[1.0]["built_km2"] == pytest.approx(0.0031)


def test_simplification(spark):
    circle = [[math.cos(a) * 100, math.sin(a) * 100] for a in np.linspace(0, 2 * math.pi, 721)]
    circle[-1] = circle[0]
    square = [[0.0, 0.0], [5.0, 0.1], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    tiny = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    table = spark.createDataFrame([(1, [circle]), (2, [square]), (3, [tiny]), (4, None)], "id int, rings array<array<array<double>>>")
    got = {x["id"]: x["rings"] for x in simplify.simplify(table, 1.0).collect()}
    assert got[4] is None and got[3] == [tiny]
    assert got[2] == [[p for p in square if p != [5.0, 0.1]]]
    assert 8 < len(got[1][0]) < 60 and got[1][0][0] == got[1][0][-1]
    kept = np.array(got[1][0])
    for x, y in circle:  # none is farther from the new ring than the tolerance
        a, d = kept[:-1], kept[1:] - kept[:-1]
        t = np.clip(((np.array([x, y]) - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.hypot(*(np.array([x, y]) - a - t[:, None] * d).T).min() <= 1 + 1e-9
    assert simplify.crosses(np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)) and not simplify.crosses(np.array(square))


def test_sinks(spark, tmp_path):
    pixels = spark.range(64).selectExpr("int(id div 8) AS r", "int(id % 8) AS c", "double(id) AS a", "id % 3 <> 0 AS valid", "int(id % 4) AS scl")
    sinks.write_scene(pixels, ["a"], f"{tmp_path}/scene", {"offset": -1000})
    full, half = (spark.read.parquet(f"{tmp_path}/scene/stack/{x}") for x in ("full", "overview_2"))
    assert full.count() == 64 and full.where("a IS NULL").count() == 22
    want = pixels.where("valid AND r < 2 AND c < 2").agg(F.avg("a")).first()[0]
    assert half.where("r = 0 AND c = 0").first()["a"] == want and half.count() == 16
    assert json.loads(spark.read.text(f"{tmp_path}/scene/stack/facts").first()[0]) == {"bands": ["a"], "tile": 512, "overviews": [2, 4, 8, 16], "offset": -1000}
    assert {r["scl"]: r["pixels"] for r in spark.read.json(f"{tmp_path}/scene/histogram").collect()} == {0: 16, 1: 16, 2: 16, 3: 16}
    sinks.write_variants(pixels.select("r", "c", F.when(F.col("c") < 4, "unary").otherwise("chosen").alias("variant")), f"{tmp_path}/maps")
    assert spark.read.parquet(f"{tmp_path}/maps").where("variant = 'unary'").count() == 32
    sinks.write_script_constant(pixels.select("r", "c").limit(2), f"{tmp_path}/js")
    lines = [line for part in sorted((tmp_path / "js").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[0] == "const DATA = [" and lines[-1] == "];" and json.loads("[" + "".join(lines[1:-1]).rstrip(",") + "]") == [{"r": 0, "c": 0}, {"r": 0, "c": 1}]
    text = sinks.metrics_text([{"name": "water", "precision": 0.5, "recall": 1.0, "f1": 2 / 3, "support": 1200}], {"macro_f1": 2 / 3, "weighted_f1": 2 / 3, "accuracy": 0.5, "kappa": 0.0, "n": 1200})
    assert text.splitlines()[0] == "class   precision   recall      f1   support" and text.splitlines()[2] == "water       0.500    1.000   0.667     1,200"
    assert text.splitlines()[-1] == "test pixels                      1,200" and len(text.splitlines()) == 9
    assert sinks.results_text([("all", pixels.select("r").orderBy("r"))]).count("\n") == 32
