"""Mean-field smoothing of class probabilities on a grid, in tiles with a halo as wide as there are steps: one shuffle for all steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.raster import OFFSETS

#: Pixels along a tile, without its halo.
TILE = 256
#: Bounds of a probability before its logarithm.
LEAST = 1e-6


def _around(grid: np.ndarray) -> list[np.ndarray]:
    """The values at the eight neighbours of every pixel; 0 beyond the edge."""
    wide = np.pad(grid, [(0, 0)] * (grid.ndim - 2) + [(1, 1), (1, 1)])
    h, w = grid.shape[-2:]
    return [wide[..., 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] for dr, dc in OFFSETS]


def weights(features: np.ndarray, valid: np.ndarray, sigma: float | None) -> list[np.ndarray]:
    """One map for each neighbour: 1 / distance, less for a contrast of features (sigma None: none); 0 if one of both is invalid, or
    lacks a feature (NaN), so that no contrast is known."""
    found = []
    for (dr, dc), other, there in zip(OFFSETS, _around(features), _around(valid), strict=True):
        near = np.hypot(dr, dc) ** -1.0
        likeness = 1.0 if sigma is None else np.nan_to_num(np.exp(((features - other) ** 2).sum(axis=0) / (-2 * sigma**2)), nan=0.0)
        found.append(np.where(valid & there, near * likeness, 0.0))
    return found


def settle(p: np.ndarray, maps: list[np.ndarray], valid: np.ndarray, theta: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """q after the steps (classes, rows, columns; 0 where invalid), and for each step the change of each pixel, summed over classes."""
    unary = np.log(np.clip(p, LEAST, 1.0))
    q = np.where(valid, p, 0.0)
    moved = np.zeros((steps, *valid.shape))
    for k in range(steps):
        score = unary + theta * sum(m * other for m, other in zip(maps, _around(q), strict=True))
        power = np.exp(score - score.max(axis=0))
        new = np.where(valid, power / power.sum(axis=0), 0.0)
        moved[k] = np.abs(new - q).sum(axis=0)
        q = new
    return q, moved


def smooth(pixels: DataFrame, thetas: Sequence[float], sigma: float | None, steps: int, n_classes: int, n_features: int, tile: int = TILE) -> DataFrame:
    """pixels: r, c, valid, p0, p1, ... (probabilities), f0, f1, ... (features, standardised). theta, r, c, valid, q (array) and
    moved (array, one sum over classes for each step) for each theta and pixel. Absent pixels are invalid ones. A group is a tile with
    its halo, whatever the scene's size."""
    p, f = [f"p{i}" for i in range(n_classes)], [f"f{i}" for i in range(n_features)]
    size = tile + 2 * steps

    def of_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = (rows[a].to_numpy() - (k * tile - steps) for a, k in zip(("r", "c"), key, strict=True))
        valid = np.zeros((size, size), bool)
        valid[y, x] = rows["valid"].fillna(False).to_numpy(bool)
        maps = np.zeros((len(p) + len(f), size, size))
        maps[:, y, x] = rows[p + f].to_numpy(float).T
        maps[: len(p)] = np.nan_to_num(maps[: len(p)])
        near = weights(maps[len(p) :], valid, sigma)
        core = (y >= steps) & (y < steps + tile) & (x >= steps) & (x < steps + tile)
        own, (y, x) = rows.loc[core], (y[core], x[core])
        results = []
        for theta in thetas:
            q, moved = settle(maps[: len(p)], near, valid, theta, steps)
            results.append(pd.DataFrame({"theta": theta, "r": own["r"], "c": own["c"], "valid": valid[y, x], "q": pd.Series(list(q[:, y, x].T), own.index, object), "moved": pd.Series(list(moved[:, y, x].T), own.index, object)}))
        return pd.concat(results)

    reached = lambda a: F.explode(F.sequence(F.floor((F.col(a) - steps) / tile), F.floor((F.col(a) + steps) / tile)))
    dealt = pixels.select("r", "c", "valid", *p, *f, reached("r").alias("tr")).withColumn("tc", reached("c"))
    return dealt.groupBy("tr", "tc").applyInPandas(of_tile, "theta double, r int, c int, valid boolean, q array<double>, moved array<double>")


def convergence(smoothed: DataFrame, n_classes: int) -> DataFrame:
    """theta, step, change: the mean absolute change of a step over valid pixels and classes."""
    each = smoothed.where("valid").select("theta", F.posexplode("moved").alias("step", "moved"))
    return each.groupBy("theta", "step").agg((F.avg("moved") / n_classes).alias("change"))


def decoded(q: Column, class_ids: Sequence[int]) -> Column:
    """The class of the largest probability, the first of equal ones; 0 without any."""
    best = F.array_max(q)
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, class_ids)), F.array_position(q, best).cast("int"))).otherwise(0)


def chosen(sweep: DataFrame, least: float = 0.75) -> DataFrame:
    """The row of the theta that keeps enough thin structures and drops the smallest area; if none keeps enough, of the smallest theta."""
    able = F.col("retention") >= least
    rank = F.when(able, F.struct(F.lit(0).alias("a"), F.col("dropped_km2").alias("b"), "theta")).otherwise(F.struct(F.lit(1).alias("a"), F.lit(0.0).alias("b"), "theta"))
    return sweep.orderBy(rank).limit(1)
