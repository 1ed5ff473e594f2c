"""Scenes that can't be chosen, shapes in the order of a space-filling key, tables and manifests."""

import json
import random

import pytest

from loamgrid.sources import files, scenes, sinks


def test_scenes_that_are_missing_or_partial(spark):
    table = spark.createDataFrame([("a", "2020-05-01", 4.0, 0.9, False), ("b", "2020-05-02", 2.0, 1.0, True), ("c", "2020-05-01", 2.0, 1.0, True), ("d", "2020-05-01", 1.0, 0.5, False)], "id string, day string, cloud double, covered double, contains_aoi boolean")
    assert scenes.pinned(table, "d").first()["cloud"] == 1.0 and scenes.best(table).first()["id"] == "c"
    with pytest.raises(ValueError, match="no scene x"):
        scenes.pinned(table, "x")
    with pytest.raises(ValueError, match=r"a \(90% of it, 4.0 % cloud\), d \(50%"):
        scenes.best(table.where("not contains_aoi"))


def test_a_window_reads_a_small_part_of_laid_out_shapes(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, x := r.uniform(-5e4, 5e4), y := r.uniform(-5e4, 5e4), x + 80, y + 80) for i in range(40_000)]
    path = f"{tmp_path}/shapes"
    sinks.write_shapes(spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double"), path, files=16)
    window = (1000.0, 1000.0, 3000.0, 4000.0)
    found = sinks.read_window(spark, path, *window)
    assert "PushedFilters: [IsNotNull(x1)" in found._jdf.queryExecution().toString()
    want = {k for k, x0, y0, x1, y1 in rows if x1 >= window[0] and x0 <= window[2] and y1 >= window[1] and y0 <= window[3]}
    assert {x["k"] for x in found.collect()} == want and want
    # files whose box columns can hold the window, by their statistics
    boxes = spark.read.parquet(path).selectExpr("*", "input_file_name() as f").groupBy("f").agg({"x0": "min", "y0": "min", "x1": "max", "y1": "max"}).collect()
    assert len(boxes) == 16 and sum(b["max(x1)"] >= window[0] and b["min(x0)"] <= window[2] and b["max(y1)"] >= window[1] and b["min(y0)"] <= window[3] for b in boxes) <= 4


def test_tables_are_replaced_with_statistics(spark):
    for n in (3, 5):
        sinks.write_table(spark.range(n).withColumnRenamed("id", "k"), "loamgrid_written")
    assert spark.table("loamgrid_written").count() == 5
    assert any("5 rows" in str(x["data_type"]) for x in spark.sql("DESCRIBE EXTENDED loamgrid_written").collect())
    spark.sql("DROP TABLE loamgrid_written")


def test_a_manifest_is_one_row(spark, tmp_path):
    (tmp_path / "latest.json").write_text(json.dumps({"newest": "S17", "scenes": [1, 2]}, indent=2))
    row = files.manifest(spark, f"{tmp_path}/latest.json").first()
    assert row["newest"] == "S17" and row["scenes"] == [1, 2]
