"""Measures of agreement between two maps, from counts of (truth, prediction) alone.

Counts have any further columns as keys (a map, a split side, a distance band), so one pass over the pixels measures all of them.
Classes are fixed beforehand: pairs of others don't count, and a class without pixels has measures of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower ends of the distance bands in metres.
BANDS = (0, 20, 50, 100, 200, 400)


def counts(df: DataFrame, keys: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """keys, truth, pred, n."""
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _among(confusion: DataFrame, classes: Sequence[int]) -> DataFrame:
    return confusion.where(F.col("truth").isin(*classes) & F.col("pred").isin(*classes))


def per_class(confusion: DataFrame, classes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, class_id, prec, recall, f1, support."""
    known = _among(confusion, classes)
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = known.select(*keys, F.col("truth").alias("class_id"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("hit"))
    sides = sides.unionByName(known.select(*keys, F.col("pred").alias("class_id"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hit")))
    every = known.select(*keys).distinct() if keys else known.sparkSession.range(1).select()
    empty = every.select(*keys, F.explode(F.array(*map(F.lit, classes))).alias("class_id"), *[F.lit(0).alias(c) for c in ("support", "predicted", "hit")])
    sums = sides.unionByName(empty).groupBy(*keys, "class_id").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    share = lambda c: F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0)
    # 2pr / (p + r) is 2 * hit over what both sides have
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return sums.select(*keys, "class_id", share("predicted").alias("prec"), share("support").alias("recall"), f1.alias("f1"), "support", "predicted", "hit")


def overall(confusion: DataFrame, classes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, accuracy, kappa, macro_f1, weighted_f1. Without pairs there is no row for a key; kappa is 0 where chance agrees fully."""
    each = per_class(confusion, classes, keys)
    n, hit = F.sum("support"), F.sum("hit")
    sums = each.groupBy(*keys).agg(n.alias("n"), hit.alias("hit"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"), F.sum("f1").alias("f1"), F.sum(F.col("f1") * F.col("support")).alias("weighted")).where("n > 0")
    agreed, chance = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(chance < 1, (agreed - chance) / (1 - chance)).otherwise(0.0)
    return sums.select(*keys, "n", agreed.alias("accuracy"), kappa.alias("kappa"), (F.col("f1") / len(classes)).alias("macro_f1"), (F.col("weighted") / F.col("n")).alias("weighted_f1"))


def band(distance: Column) -> Column:
    """The lower end of the band that a distance lies in; null for no distance."""
    out = F.when(distance >= BANDS[-1], BANDS[-1])
    for low, high in zip(reversed(BANDS[:-1]), reversed(BANDS[1:]), strict=True):
        out = out.when((distance >= low) & (distance < high), low)
    return out


def accuracy_by(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, accuracy."""
    return confusion.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
