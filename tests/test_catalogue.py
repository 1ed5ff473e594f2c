"""Every query with SQL gives the same rows in Spark and DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from loamgrid.operators import raster
from loamgrid.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in catalogue.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def shown(value):
    return float(f"{float(value):.5g}") + 0.0 if isinstance(value, int | float) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, FOLDER)
    reader = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in reader.description]
    theirs = reader.fetchall()
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted((tuple(shown(r[c]) for c in order) for r in frame.collect()), key=str)
    assert mine == sorted((tuple(shown(r[columns.index(c)]) for c in order) for r in theirs), key=str)


def test_uniform_map_has_no_edges_and_halves_meet_at_the_middle(spark):
    line = spark.createDataFrame([(0, c, 1 if c < 6 else 2) for c in range(11)], "r int, c int, label int")
    edges = {r["c"] for r in raster.boundary(line).where("edge").collect()}
    assert edges == {5, 6}
    assert {r["c"]: r["distance_m"] for r in raster.boundary_distance(line).collect()} == {c: 10.0 * min(abs(c - 5), abs(c - 6)) for c in range(11)}
    assert not raster.boundary(line.withColumn("label", line["c"] * 0)).where("edge").count()


def test_mean_field_keeps_probabilities_and_absorbs_a_speck(spark):
    rows = [(r, c, [0.4, 0.6] if (r, c) == (4, 4) else [0.9, 0.1]) for r in range(9) for c in range(9)]
    pixels = spark.createDataFrame(rows, "r int, c int, p array<double>")
    after = {(r["r"], r["c"]): r["q"] for r in raster.mean_field(pixels, 0.8, 2, 2).collect()}
    assert all(math.isclose(sum(q), 1) for q in after.values()) and len(after) == 81
    assert after[4, 4][0] > 0.5
    alone = {(r["r"], r["c"]): r["q"] for r in raster.mean_field(pixels, 0.0, 1, 2).collect()}
    assert alone[4, 4][1] > 0.5
