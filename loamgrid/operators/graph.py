"""Connected components by joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.stored import discard, stash_observed

ROUNDS = 60


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links: columns a and b, two longs each, and a bound of their rows if there is one. Returns id, component (the smallest id that links reach), for ids with a link to another.

    Large and small stars by turns: each id links its larger neighbours, then all of them, to its smallest one, until nothing
    changes. A round is one job; its links are a table in the shared folder, and their number and sums come with it. A hub's
    neighbours are reduced to their minimum, never gathered.
    """
    edges, size = _stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    for _ in range(ROUNDS):
        if not size["n"]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, (edges, now) = edges, _stored(small.where("u <> v").distinct(), size["n"])
        discard(before)
        if now == size:
            break
        size = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stored(edges: DataFrame, rows: int | None) -> tuple[DataFrame, dict]:
    """With the number of links, and sums that change with them."""
    mixed = lambda *c: F.coalesce(F.sum(F.pmod(F.xxhash64(*c), F.lit(1 << 31))), F.lit(0))
    return stash_observed(edges, F.count(F.lit(1)).alias("n"), mixed("u", "v").alias("x"), mixed("v", "u").alias("y"), rows=rows)
