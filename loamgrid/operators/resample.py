"""Rasters onto other grids, by separable kernels over tiles with a halo.

A destination pixel's centre lies somewhere between the centres of source pixels; its value is the mean of those around it, weighted
by the kernel along rows and columns. Masked source pixels (missing, null or NaN) don't count, and the weights of the others are
scaled up; a pixel whose nearest source pixel is masked, or that lies outside the source, is masked too. Weights stretch with the
step where the destination is coarser, so all source pixels count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Destination rows and columns of a tile.
TILE = 256


def _bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


#: Weights by distance in source pixels, and how far they reach.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], int]] = {"bilinear": (_bilinear, 1), "cubic": (_cubic, 2)}


def resample(pixels: DataFrame, value: str, height: int, width: int, source: tuple[int, int], kernel: str = "nearest", origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (0.5, 0.5), tile: int = TILE) -> DataFrame:
    """r, c, value of a grid of height x width that begins at `origin` (row, column) of the source's corner, one pixel being `step`
    (rows, columns) of the source's. source: the source's height and width. Only unmasked pixels are returned."""
    reach = [int(np.ceil(KERNELS[kernel][1] * max(1.0, s))) if kernel != "nearest" else 1 for s in step]

    def tiles_of(column: str, i: int) -> Column:
        """The tiles whose pixels may need a source row or column: it may serve centres a little before to a little after."""
        last = (height, width)[i] - 1
        low = F.floor((F.col(column) - reach[i] - origin[i]) / step[i] - 0.5)
        high = F.ceil((F.col(column) + 1 + reach[i] - origin[i]) / step[i] + 0.5)
        clip = lambda x: F.floor(F.greatest(F.lit(0), F.least(F.lit(last), x)) / tile)
        return F.when((high < 0) | (low > last), F.array()).otherwise(F.sequence(clip(low), clip(high)))

    def of_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(rows["r"].min()), int(rows["c"].min())
        grid = np.full((int(rows["r"].max()) - y0 + 1, int(rows["c"].max()) - x0 + 1), np.nan)
        grid[rows["r"] - y0, rows["c"] - x0] = rows["value"].to_numpy(float)
        r, c = (np.arange(k * tile, min((k + 1) * tile, n)) for k, n in zip(key, (height, width), strict=True))
        at = [o + (i + 0.5) * s for o, s, i in zip(origin, step, (r, c), strict=True)]  # centres, from the source's corner
        inside = [(a >= 0) & (a < n) for a, n in zip(at, source, strict=True)]
        nearest = [np.floor(a).astype(np.int64) - z for a, z in zip(at, (y0, x0), strict=True)]
        there = [i & (n >= 0) & (n < size) for i, n, size in zip(inside, nearest, grid.shape, strict=True)]
        own = grid[np.ix_(np.clip(nearest[0], 0, grid.shape[0] - 1), np.clip(nearest[1], 0, grid.shape[1] - 1))]
        own = np.where(there[0][:, None] & there[1][None, :], own, np.nan)
        if kernel != "nearest":
            weigh, _ = KERNELS[kernel]
            parts = []
            for a, z, size, s in zip(at, (y0, x0), grid.shape, step, strict=True):
                away = (np.arange(size)[None, :] + z + 0.5 - a[:, None]) / max(1.0, s)
                parts.append(weigh(away))
            known = ~np.isnan(grid)
            total = parts[0] @ known.astype(float) @ parts[1].T
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(np.isnan(own) | (total <= 0), np.nan, parts[0] @ np.where(known, grid, 0.0) @ parts[1].T / total)
        i, j = np.nonzero(~np.isnan(own))
        return pd.DataFrame({"r": r[i], "c": c[j], "value": own[i, j]})

    known = pixels.select("r", "c", F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    sent = known.withColumn("tile_r", F.explode(tiles_of("r", 0))).withColumn("tile_c", F.explode(tiles_of("c", 1)))
    return sent.groupBy("tile_r", "tile_c").applyInPandas(of_tile, "r long, c long, value double")
