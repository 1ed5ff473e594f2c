"""Polygons onto a grid by scanlines.

A pixel belongs to a polygon if its centre lies inside by the even-odd rule, so holes and concave rings come out right; centres on a
left or lower edge count. Every edge is met with the row centres that it spans; the crossings of a polygon with a row, sorted, are
the ends of runs of pixels by pairs. Row 0 begins at y = 0, column 0 at x = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.polygons import edges


def _first(x: Column, size: float) -> Column:
    """The first pixel whose centre is at x or beyond."""
    return F.ceil(x / size - 0.5)


def runs(polygons: DataFrame, key: list[str], size: float, rings: str = "rings") -> DataFrame:
    """key, r, c0, c1: runs of pixels of each polygon. key tells the polygons apart."""
    each = polygons.select(*key, F.explode(rings).alias("ring")).select(*key, F.explode(edges(F.col("ring"))).alias("e"))
    ends = each.select(*key, *[F.col("e")[p][i].alias(f"{n}{p}") for p in ("a", "b") for i, n in enumerate("xy")]).where("ya <> yb")
    rows = ends.withColumn("low", _first(F.least("ya", "yb"), size)).withColumn("high", _first(F.greatest("ya", "yb"), size) - 1).where("low <= high").withColumn("r", F.explode(F.sequence("low", "high")))
    y = (F.col("r") + 0.5) * size
    crossings = rows.select(*key, "r", (F.col("xa") + (F.col("xb") - F.col("xa")) * (y - F.col("ya")) / (F.col("yb") - F.col("ya"))).alias("x"))
    sorted_ = crossings.groupBy(*key, "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # as many as the polygon has edges there
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("x0"), F.get("xs", i + 1).alias("x1")))
    found = sorted_.select(*key, "r", F.explode(pairs).alias("p"))
    return found.select(*key, "r", _first(F.col("p.x0"), size).alias("c0"), (_first(F.col("p.x1"), size) - 1).alias("c1")).where("c0 <= c1")


def pixels(polygons: DataFrame, key: list[str], size: float, rings: str = "rings") -> DataFrame:
    """key, r, c: all pixels of each polygon."""
    return runs(polygons, key, size, rings).select(*key, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def rasterise(polygons: DataFrame, value: str, order: list[str], size: float, rings: str = "rings") -> DataFrame:
    """r, c, value: of the polygons that have a pixel the first by order (as a rule the smallest); order tells polygons apart."""
    found = pixels(polygons.select(value, *order, rings), [value, *order], size, rings)
    return found.groupBy("r", "c").agg(F.min_by(value, F.struct(*order)).alias(value))
