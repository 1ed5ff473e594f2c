"""Measures of agreement against a published matrix, and of several maps at once."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import forest, measures

#: A published confusion matrix (rows: truth) over these classes, and what was published of it.
CLASSES = (1, 2, 4, 5, 6, 7, 8)
MATRIX = (
    (266604, 14547, 14380, 6230, 24251, 5, 16), (19620, 96303, 26237, 18640, 11823, 30, 119), (16190, 20558, 126921, 19060, 12405, 5, 30), (15222, 37283, 78078, 19690, 19824, 11, 14),
    (12344, 3761, 12338, 3631, 327860, 583, 1164), (1667, 1346, 2522, 1357, 29614, 415, 360), (1712, 1606, 1295, 601, 74380, 900, 1688),
)
TOTALS = {"n": 1345240, "accuracy": 0.6240380898575719, "macro_f1": 0.4147624972745553, "weighted_f1": 0.5759883961314816, "kappa": 0.5230739397515959}
MIXED_FOREST = {"prec": 0.497788263049248, "recall": 0.02053977756686379, "f1": 0.03945169621259042, "support": 82182}


def test_measures_of_a_published_matrix(spark):
    rows = [(t, p, n) for t, line in zip(CLASSES, MATRIX, strict=True) for p, n in zip(CLASSES, line, strict=True)] + [(99, 1, 7), (1, 0, 5)]
    table = spark.createDataFrame(rows, "truth int, pred int, n long")
    found = {x["class_id"]: x for x in measures.per_class(table, CLASSES).collect()}
    assert all(found[8][k] == pytest.approx(v, rel=1e-12) for k, v in MIXED_FOREST.items())
    got = measures.overall(table, CLASSES).first()
    assert all(got[k] == pytest.approx(v, rel=1e-12) for k, v in TOTALS.items())


def test_maps_and_bands_in_one_pass(spark):
    r = random.Random(1)
    rows = [(m, r.choice([1, 2, 3]), r.choice([1, 2, 4]), r.choice([0.0, 19.9, 20.0, 99.0, 400.0, 1e6, None])) for m in "ab" for _ in range(300)] + [("c", 9, 9, 1.0)]
    table = spark.createDataFrame(rows, "map string, truth int, pred int, d double").withColumn("band", measures.band(F.col("d")))
    table = measures.counts(table, ["map", "band"])
    got = {x["map"]: x for x in measures.overall(table, (1, 2, 5), ["map"]).collect()}
    assert set(got) == {"a", "b"}
    for m in "ab":
        own = [(t, p) for k, t, p, _ in rows if k == m and t < 3 and p < 3]
        f1 = [2 * own.count((c, c)) / (sum(t == c for t, _ in own) + sum(p == c for _, p in own)) for c in (1, 2)]
        assert got[m]["n"] == len(own) and got[m]["macro_f1"] == pytest.approx(sum(f1) / 3)
    bands = {(x["map"], x["band"]): (x["n"], x["accuracy"]) for x in measures.accuracy_by(table, ["map", "band"]).collect()}
    own = [(t, p) for k, t, p, d in rows if k == "a" and d in (20.0,)]
    assert bands["a", 20] == (len(own), pytest.approx(sum(t == p for t, p in own) / len(own)))
    assert {b for m, b in bands if m == "a"} == {0, 20, 50, 400, None}


def test_models_are_saved_and_predict_no_invalid_pixel(spark, tmp_path):
    r = random.Random(4)
    table = spark.createDataFrame([(i, r.random() + 2 * (i % 2), 1 + i % 2, i % 5 != 0 if i % 7 else None) for i in range(200)], "id int, x double, label int, valid boolean")
    model = forest.fit(table, ["x"], trees=3, depth=3)
    forest.save(model, f"{tmp_path}/model")
    rows = forest.predict(forest.load(f"{tmp_path}/model"), table, F.col("valid")).collect()
    assert len(rows) == 200 and all((x["pred"] == 0) == (not x["valid"]) for x in rows)
    assert forest.evaluated(model, table, (1, 2)).first()["accuracy"] > 0.95
