"""What larger tables bring: many rows in one file, keys that repeat, long columns of pixels."""

import random

import duckdb
import pytest

from loamgrid.operators import planar, raster, regions, smoothing
from loamgrid.plans import catalogue
from tests.test_catalogue import shown

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Tables with commune numbers that several communes have, as numbers have four digits, and with shapes of one form."""
    folder = tmp_path_factory.mktemp("repeated")
    numbers = [*range(40), 88, 89, 1000, *range(10000, 10010), 2034, *range(20340, 20350)]
    tables = {
        "supplier": f"SELECT k AS s_suppkey, 'Supplier#' || CAST(k % 1000 AS VARCHAR) AS s_name, CAST(k % 25 AS INT) AS s_nationkey, 0.0 AS s_acctbal FROM (SELECT unnest({numbers}) AS k) x",
        "part": "SELECT k AS p_partkey, CAST(k % 20000 % 49 + 1 AS INT) AS p_size, 1.0 AS p_retailprice FROM range(0, 60000, 50) x(k)",
        "customer": "SELECT k AS c_custkey, ['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE'][k % 5 + 1] AS c_mktsegment FROM range(0, 8000, 6) x(k)",
    }
    for table in catalogue.TABLES:
        duckdb.execute(f"COPY ({tables.get(table, f"SELECT * FROM '{FOLDER}/{table}.parquet'")}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


def both(spark, folder, name, leave=()):
    """Rows in Spark and in DuckDB, sorted."""
    connection = duckdb.connect()
    for table in catalogue.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    reader = connection.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in reader.description]
    kept = [c for c in columns if c not in leave]
    theirs = [tuple(shown(r[columns.index(c)]) for c in kept) for r in reader.fetchall()]
    mine = [tuple(shown(r[c]) for c in kept) for r in catalogue.QUERIES[name](spark, folder).collect()]
    return sorted(mine, key=str), sorted(theirs, key=str)


def ring(r):
    points = [[float(r.randrange(6)), float(r.randrange(6))] for _ in range(r.randrange(1, 6))]
    return [*points, points[0]] if r.random() < 0.8 else points


def test_repair_deals_rows_out_and_takes_a_batch_at_once(spark):
    r = random.Random(4)
    rows = [(i, None if i % 9 == 0 else [ring(r) for _ in range(r.randrange(2))]) for i in range(300)]
    table = spark.createDataFrame(rows, "k int, rings array<array<array<double>>>").coalesce(1)
    found = planar.repaired(table)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    closed = lambda x: x if x[0] == x[-1] else [*x, x[0]]
    got = {x["k"]: x["polygons"] for x in found.collect()}
    assert got == {k: None if x is None else planar.faces([closed(y) for y in x]) for k, x in rows}
    assert sum(len(x or []) for x in got.values()) > 100


def test_distances_along_long_columns(spark):
    r = random.Random(2)
    labels = {(i, c): (i // 40 + c // 2 + (r.random() < 0.02)) % 3 for i in range(300) for c in range(4)}
    edge = [p for p, x in labels.items() if any(labels.get((p[0] + dr, p[1] + dc), x) != x for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    pixels = spark.createDataFrame([(*p, x) for p, x in labels.items()], "r int, c int, label int")
    got = {(x["r"], x["c"]): x["distance_m"] for x in raster.boundary_distance(pixels).collect()}
    assert got == {(i, c): round(10 * min((i - y) ** 2 + (c - x) ** 2 for y, x in edge) ** 0.5, 6) for i, c in labels}


@pytest.mark.parametrize("name", ["boundary_distance", "accuracy_by_distance", "disagreement", "uncertain_fraction"])
def test_no_window_starts_anew_for_every_pixel(spark, name):
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("name", ["spatial_join3", "q_new_built", "choropleth_bins", "join_using", "q_choropleth", "q_commune_cover", "q_top_built", "two_level_agg", "spatial_join", "commune_aoi", "join_aoi", "load_communes", "zonal_communes"])
def test_communes_that_share_a_number(spark, repeated, name):
    leave = ("commune",) if "LIMIT" in catalogue.ORACLES[name] else ()  # which of a number's communes comes first is open
    mine, theirs = both(spark, repeated, name, leave)
    assert mine == theirs and mine


def test_outlines_send_no_scene_through_the_driver(spark, monkeypatch):
    plans, store, observe = [], regions.stash, regions.stash_observed
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(regions, "stash", lambda df: store(noted(df)))
    monkeypatch.setattr(regions, "stash_observed", lambda df, *values: observe(noted(df), *values))
    found = regions.outlines(catalogue.run(spark, FOLDER, catalogue.INPUT))
    noted(found)
    assert found.count() and sum("SortMergeJoin" in x for x in plans) > 3 and not any("BroadcastHashJoin" in x for x in plans)


def test_a_pixel_without_a_feature_leaves_its_neighbours_alone(spark):
    rows = [(0, c, True, 0.8 if c == 0 else 0.1, 0.1 if c == 0 else 0.8, None if c == 1 else 0.5) for c in range(4)]
    pixels = spark.createDataFrame(rows, "r int, c int, valid boolean, p0 double, p1 double, f0 double")
    q = {x["c"]: x["q"][0] for x in smoothing.smooth(pixels, [0.8], 1.0, 1, 2, 1).collect()}
    alone = lambda p0, p1: p0 / (p0 + p1)
    assert q[0] == pytest.approx(alone(0.8, 0.1)) and q[1] == pytest.approx(alone(0.1, 0.8)) and q[2] < alone(0.1, 0.8) - 0.01 and q[3] == pytest.approx(q[2])
    even = {x["c"]: x["q"][0] for x in smoothing.smooth(pixels, [0.8], None, 1, 2, 1).collect()}  # without contrast all neighbours count
    assert even[0] != pytest.approx(q[0])


@pytest.mark.parametrize("name", ["rf_oof", "oof_accuracy"])
def test_out_of_fold_at_rows_whose_draw_passes_32_bits(spark, tmp_path, name):
    duckdb.execute(f"COPY (SELECT * REPLACE (event_id + 36000000 AS event_id) FROM '/root/testdata/sf0.01/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    drawn = catalogue.learnt(spark, str(tmp_path))
    assert drawn.where("drawn <> CASE WHEN (r * 7919L + c * 104729L) % 1000003 < 300001 THEN 1 ELSE 0 END").count() == 0
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    assert found.count() == (drawn.count() if name == "rf_oof" else 1)
