"""Percentiles, ranks and splits against sorting in one place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import blocks, selection


def test_percentiles_of_groups(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1e-3), r.uniform(-1e9, 1e9), 0.0, -0.0, 5.0, float("inf"), None, float("nan")])) for _ in range(900)] + [("one", 7.25), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    known = lambda g=...: [v for k, v in rows if v is not None and v == v and v != float("inf") and (g is ... or k == g)]
    got = {x["g"]: tuple(x)[1:] for x in selection.percentiles(table.where("v <> double('infinity') or v is null"), "v", [0.0, 0.02, 0.5, 1.0], ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, values in got.items():
        assert values == pytest.approx(np.percentile(known(g), [0, 2, 50, 100]).tolist(), rel=1e-12, abs=1e-300)
    assert tuple(selection.percentiles(table.where("v <> double('infinity')"), F.col("v") * 2, [0.98]).first()) == pytest.approx([2 * np.percentile(known(), 98)])
    assert selection.percentiles(table.limit(0), "v", [0.5], ["g"]).count() == 0 and tuple(selection.percentiles(table.limit(0), "v", [0.5]).first()) == (None,)


def test_ranks_and_first_rows(spark):
    table = spark.range(5000).select(F.col("id").alias("k"))
    order = [x["k"] for x in table.orderBy(selection.draw("k", seed=3), "k").collect()]
    got = {x["k"]: x["rank"] for x in selection.ranked(table, selection.draw("k", seed=3), ["k"]).collect()}
    assert [got[k] for k in order] == list(range(1, 5001))
    for n in (0, 1, 777, 5000, 9000):
        assert sorted(x["k"] for x in selection.first_rows(table, n, selection.draw("k", seed=3), ["k"]).collect()) == sorted(order[:n])
    few = selection.ranked(table.where("k < 40"), F.col("k") % 7, ["k"], bits=3)
    assert [x["k"] for x in few.orderBy("rank").collect()] == sorted(range(40), key=lambda k: (k % 7, k))


def pixels(spark, n_blocks, seed=1):
    r = random.Random(seed)
    rows = [(i, b, b % 5 != 0 and r.random() < 0.8, r.random() < 0.9) for b in range(n_blocks) for i in range(b * 20, b * 20 + 20)]
    return spark.createDataFrame(rows, "i int, block int, eligible boolean, assigned boolean")


def test_blocks_are_split_whole_and_by_the_seed(spark):
    table = pixels(spark, 40)
    sides = lambda **o: {(x["block"], x["side"]) for x in blocks.split(table, **o).where("eligible").collect()}
    found = sides()
    assert len(found) == 32 and sum(s == "test" for _, s in found) == round(0.3 * 32)
    assert found == sides() != sides(seed=7)
    assert {x["side"] for x in blocks.split(table).where("not eligible").collect()} == {None}
    with pytest.raises(ValueError, match="3 blocks"):
        blocks.split(pixels(spark, 4))


def test_folds_are_even_and_cover_what_is_assigned(spark):
    table = pixels(spark, 40)
    rows = blocks.folded(table).collect()
    fold = {}
    for x in rows:
        if x["eligible"] or x["assigned"]:
            assert fold.setdefault(x["block"], x["fold"]) == x["fold"] >= 0
        else:
            assert x["fold"] == -1
    own = {x["block"] for x in rows if x["eligible"]}
    sizes = [sum(fold[b] == k for b in own) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1 and len(fold) == 40
    every = [sum(f == k for f in fold.values()) for k in range(5)]
    assert every == [8] * 5
