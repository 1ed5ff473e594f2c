"""Forests, polygons, files and components against plain versions on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import forest, polygons, raster
from loamgrid.sources import files, sinks


def test_polygons_with_a_hole(spark):
    outer, hole, bow = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]], [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]
    g = spark.createDataFrame([([outer, hole], bow)], "rings array<array<array<double>>>, bow array<array<double>>")
    rings, bow_ = F.col("rings"), F.col("bow")
    row = g.select(
        polygons.area(rings), polygons.perimeter(rings), polygons.contains(rings, F.lit(5.0), F.lit(5.0)), polygons.contains(rings, F.lit(1.0), F.lit(1.0)), polygons.contains(rings, F.lit(11.0), F.lit(1.0)),
        polygons.area(F.array(polygons.clip(rings[0], F.lit(5.0), F.lit(-5.0), F.lit(20.0), F.lit(5.0)))), polygons.is_valid(rings[0]), polygons.is_valid(bow_), polygons.is_valid(F.slice(rings[0], 1, 3)),
    ).first()
    assert tuple(row) == (96.0, 48.0, False, True, False, 25.0, True, False, False)


def test_scripts_and_collections(spark):
    script = "-- the head of the file\n-- and more\n\n-- first\nCREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1 AS a;\n\n-- a title\n-- more\nselect a from v;\n-- nothing\n"
    assert [t for t, _ in files.statements(script)] == ["first", "a title"]
    results = files.run_script(spark, script)
    assert results[0][1] is None and results[1][1].collect()[0]["a"] == 1
    assert "a title" in sinks.results_text(results) and "done" in sinks.results_text(results)
    assert files.statements("-- far away\n\nselect 1;select 2")[0][0] == files.statements("select 1")[0][0] == "query"
    texts = spark.createDataFrame([('{"features": [{"properties": {"A": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}',)], "text string")
    assert files.features(texts, "A int").first()["a"] == 1
    with pytest.raises(ValueError, match="feature"):
        files.features(spark.createDataFrame([('{"features": []}',)], "text string"), "A int")
    with pytest.raises(Exception, match="full"):
        files.features(spark.createDataFrame([('{"error": "full"}',)], "text string"), "A int").collect()


def test_forest_learns_and_folds_are_guarded(spark):
    r = random.Random(4)
    rows = [(i, r.random(), r.random(), i % 3) for i in range(300)]
    table = spark.createDataFrame([(i, x + 2 * (k == 1), y + 2 * (k == 2), k + 1, i // 3 % 4) for i, x, y, k in rows], "id int, x double, y double, label int, fold int")
    out = forest.out_of_fold(table, ["x", "y"], 4, trees=5, depth=4)
    assert out.count() == 300 and out.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0] > 0.95
    assert forest.subsample(table, 17, ["id"]).count() == 17 and forest.subsample(table, None, ["id"]).count() == 300
    with pytest.raises(ValueError, match="fold 0"):
        forest.out_of_fold(table.where("label <> 3 or fold = 0"), ["x", "y"], 4, trees=2, depth=2)


def test_boundary_distance_matches_all_pairs(spark):
    r = random.Random(2)
    label = {(i, j): i // 5 + j // 8 + (r.random() < 0.03) for i in range(11) for j in range(17)}
    table = spark.createDataFrame([(i, j, v) for (i, j), v in label.items()], "r int, c int, label int")
    edges = [(x["r"], x["c"]) for x in raster.boundary(table).where("edge").collect()]
    want = {(i, j): round(min((i - a) ** 2 + (j - b) ** 2 for a, b in edges) ** 0.5 * 10, 6) for i, j in label}
    assert {(x["r"], x["c"]): x["distance_m"] for x in raster.boundary_distance(table).collect()} == want
    assert {x["distance_m"] for x in raster.boundary_distance(table.withColumn("label", F.lit(1))).collect()} == {None}
