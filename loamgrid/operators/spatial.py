"""Spatial joins over bounding boxes: cells instead of nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 2_000.0


def cells(df: DataFrame, cell: float) -> DataFrame:
    """df with a row for each cell that a box touches."""
    span = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}0") / cell), F.floor(F.col(f"{p}1") / cell)))
    return df.withColumn("cell_x", span("x")).withColumn("cell_y", span("y"))


def spatial_join(left: DataFrame, right: DataFrame, cell: float = CELL, tasks: int | None = None) -> DataFrame:
    """Pairs of boxes that meet or touch, as columns l and r (structs). An equi-join on cells; a pair that meets in several cells
    is kept in the one that holds the lower corner of what they share, so nothing has to be made distinct. Boxes much larger
    than a cell cost a row for each cell, so the cell should be near the size of the larger kind. tasks: how many share the cells,
    where few boxes make many pairs, or pairs that take long."""
    pack = lambda df, n: cells(df, cell).select("cell_x", "cell_y", F.struct(*df.columns).alias(n))
    low = lambda p: F.floor(F.greatest(F.col(f"l.{p}0"), F.col(f"r.{p}0")) / cell)
    meet = lambda p: F.greatest(F.col(f"l.{p}0"), F.col(f"r.{p}0")) <= F.least(F.col(f"l.{p}1"), F.col(f"r.{p}1"))
    dealt = lambda df: df.repartition(tasks, "cell_x", "cell_y") if tasks else df
    pairs = dealt(pack(left, "l")).join(dealt(pack(right, "r")), ["cell_x", "cell_y"])
    return pairs.where(meet("x") & meet("y") & (F.col("cell_x") == low("x")) & (F.col("cell_y") == low("y"))).select("l", "r")
