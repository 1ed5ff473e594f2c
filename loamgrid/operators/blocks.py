"""Splits and folds by blocks of pixels, so that neighbours stay on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import selection
from loamgrid.stored import stash

SEED = 42
#: The fewest blocks that can be split, the share of the test side, and the folds.
FEWEST, TEST, FOLDS = 4, 0.3, 5


def permuted(blocks: DataFrame, by: Column | None = None, bits: int = 63, seed: int = SEED) -> DataFrame:
    """blocks: block, distinct. block and its place (k, from 1) in a permutation by the seed, or by a given draw."""
    order = selection.draw("block", seed=seed) if by is None else by
    return selection.ranked(blocks.select("block").distinct(), order, ["block"], "k", bits if by is not None else 63)


def test_blocks(pixels: DataFrame, share: float = TEST, **draw) -> DataFrame:
    """pixels: block, eligible. The blocks of the test side; an error if fewer than four have an eligible pixel."""
    order = stash(permuted(pixels.where("eligible"), **draw))
    n = order.count()
    if n < FEWEST:
        raise ValueError(f"{n} blocks have an eligible pixel, which are too few to split; take smaller blocks or a larger area")
    return order.where(F.col("k") <= max(1, round(share * n))).select("block")


def split(pixels: DataFrame, share: float = TEST, **draw) -> DataFrame:
    """pixels with side: test, train, or null where a pixel isn't eligible."""
    chosen = test_blocks(pixels, share, **draw).withColumn("__test", F.lit(True))
    side = F.when(F.col("eligible"), F.when(F.col("__test"), "test").otherwise("train"))
    return pixels.join(chosen, "block", "left").withColumn("side", side).drop("__test")


def fold_blocks(pixels: DataFrame, folds: int = FOLDS, **draw) -> DataFrame:
    """block, fold: those with an eligible pixel in turn, then those that only have assigned ones. pixels: block, eligible, assigned."""
    held = pixels.groupBy("block").agg(F.max("eligible").alias("eligible"), F.max("assigned").alias("assigned"))
    first = stash(permuted(held.where("eligible"), **draw))
    n = first.count()
    extra = permuted(held.where("assigned and not eligible"), **draw).withColumn("k", F.col("k") + n)
    return first.unionByName(extra).select("block", ((F.col("k") - 1) % folds).cast("int").alias("fold"))


def folded(pixels: DataFrame, folds: int = FOLDS, **draw) -> DataFrame:
    """pixels with fold: -1 where a pixel is neither eligible nor assigned."""
    found = pixels.join(fold_blocks(pixels, folds, **draw), "block", "left")
    return found.withColumn("fold", F.when(F.col("eligible") | F.col("assigned"), F.col("fold")).otherwise(-1))
