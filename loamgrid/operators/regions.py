"""Regions of equal labels: components in tiles, seams between tiles, and their outlines as rings.

A grid is a table of pixels (r, c, label); a pixel that is missing is masked, and parts regions as another label does. Null is a
label like others. A pixel's number is its row and column side by side in 64 bits, so rows and columns may have 31 bits each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.operators.graph import components as linked
from loamgrid.stored import discard, stash, stash_observed

#: Rows and columns of a tile.
TILE = 512


def number(r: Column, c: Column) -> Column:
    return F.shiftleft(r.cast("long"), 32) + c.cast("long")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the scene. Stored tables of it are so small that Spark would send all of them through the driver."""
    return df.hint("merge")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each is linked with, over links a[i] - b[i]: all links at once, and all paths halved, until nothing moves."""
    up = np.arange(n)
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    return up


def _tile_runs(offsets: Sequence[tuple[int, int]], kind: pa.DataType):
    """Of a tile's pixels: its runs along rows with the number of the region's first pixel within the tile."""

    def solve(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        labels = table.column("label").combine_chunks().take(pa.array(order))
        code = pc.dictionary_encode(labels, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1) | (code[1:] != code[:-1])
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        low_r, low_c = int(r.min()), int(c.min())
        grid = np.full((int(r.max()) - low_r + 1, int(c.max()) - low_c + 1), -1, np.int64)
        grid[r - low_r, c - low_c] = np.arange(len(r))
        links = []
        for dr, dc in offsets:
            if dr or dc != 1:
                y, x = r - low_r + dr, c - low_c + dc
                inside = (y >= 0) & (y < grid.shape[0]) & (x >= 0) & (x < grid.shape[1])
                other = np.where(inside, grid[np.where(inside, y, 0), np.where(inside, x, 0)], -1)
                met = (other >= 0) & (code[other] == code)
                links.append(np.stack([run[met], run[other[met]]]))
        a, b = np.unique(np.concatenate([np.empty((2, 0), np.int64), *links], axis=1), axis=1)
        root = starts[roots(len(starts), a, b)]  # runs are in order, so the smallest run has the first pixel
        size = np.diff(np.append(starts, len(r)))
        columns = [pa.array(r[starts]), pa.array(c[starts]), pa.array(size), labels.take(pa.array(starts)), pa.array((r[root] << 32) + c[root])]
        return pa.Table.from_arrays(columns, names=["r", "c", "n", "label", "node"])

    return solve


def region_runs(pixels: DataFrame, offsets: Sequence[tuple[int, int]] = ((0, 1), (1, 0)), tile: int = TILE) -> DataFrame:
    """r, c, n, label, component: runs of n pixels along rows and the number of their region's first pixel. (0, 1) is always among the
    offsets' meaning. Pixels are shuffled once, by tile; then only runs, and the seams' part of the graph, are joined."""
    kind = pixels.schema["label"].dataType
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in ("r", "c", "n")], T.StructField("label", kind), T.StructField("node", T.LongType())])
    dealt = pixels.select("r", "c", "label", F.floor(F.col("r") / tile).alias("tile_r"), F.floor(F.col("c") / tile).alias("tile_c"))
    runs = stash(dealt.groupBy("tile_r", "tile_c").applyInArrow(_tile_runs(offsets, kind), schema))
    last = F.col("c") + F.col("n") - 1
    side = lambda x, at: F.pmod(x, F.lit(tile)) == at
    whole = side(F.col("r"), 0) | side(F.col("r"), tile - 1)
    ends = F.array_distinct(F.filter(F.array(F.col("c"), last), lambda x: side(x, 0) | side(x, tile - 1)))
    seam = stash(runs.select("r", "label", "node", F.explode(F.when(whole, F.sequence("c", last)).otherwise(ends)).alias("c")))
    links = None
    for dr, dc in dict.fromkeys([(0, 1), *offsets]):
        moved = seam.select((F.col("r") + dr).alias("r2"), (F.col("c") + dc).alias("c2"), F.col("label").alias("label2"), F.col("node").alias("a"))
        met = seam.join(large(moved), (F.col("r") == F.col("r2")) & (F.col("c") == F.col("c2")) & F.col("label").eqNullSafe(F.col("label2"))).where("a <> node").select("a", F.col("node").alias("b"))
        links = met if links is None else links.unionByName(met)
    found = stash(linked(links))
    discard(seam)
    return runs.join(large(found), F.col("node") == F.col("id"), "left").select("r", "c", "n", "label", F.coalesce("component", "node").alias("component"))


def components(pixels: DataFrame, offsets: Sequence[tuple[int, int]] = ((0, 1), (1, 0)), tile: int = TILE) -> DataFrame:
    """r, c, label, component for each pixel."""
    runs = region_runs(pixels, offsets, tile)
    at = F.explode(F.sequence("c", F.col("c") + F.col("n") - 1))
    return runs.select(F.col("r").cast("int").alias("r"), at.alias("c"), "label", "component").withColumn("c", F.col("c").cast("int"))


# outlines

#: Fixed order: the four sides of a pixel against the clock, rows running down: bottom, right, top, left. Of each: how it starts and
#: runs (corners are numbered like pixels, the upper left one as the pixel), and the pixels ahead on the left and on the right.
_SIDES = (
    {"start": (1, 0), "step": (0, 1), "left": (0, 1), "right": (1, 1), "beyond": (1, 0)},
    {"start": (1, 1), "step": (-1, 0), "left": (-1, 0), "right": (-1, 1), "beyond": (0, 1)},
    {"start": (0, 1), "step": (0, -1), "left": (0, -1), "right": (-1, -1), "beyond": (-1, 0)},
    {"start": (0, 0), "step": (1, 0), "left": (1, 0), "right": (1, -1), "beyond": (0, -1)},
)


def outlines(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """label, component, ring, size, signed, points: the rings of each region of four neighbours, as corners (r, c) in order, without
    those on straight lines. size is the ring's length in pixels; signed is its area, positive for outer rings and negative for
    holes. Rings that touch at a corner are rings of their own.

    Sides of pixels towards another region are linked, each with the side that follows it against the clock; then every side learns
    the smallest number within its next 1, 2, 4, ... sides and how far it is, until all of its ring is known. So a ring of any
    length, or any number of them, is put in order by joins, and only the corners of one ring come together."""
    own = stash(components(pixels, ((0, 1), (1, 0)), tile))
    known = own.select("r", "c", "label", "component")
    sides = None
    for i, s in enumerate(_SIDES):
        at = lambda way, s=s: large(known.select((F.col("r") - s[way][0]).alias("r"), (F.col("c") - s[way][1]).alias("c"), F.col("component").alias(way)))
        near = known.join(at("beyond"), ["r", "c"], "left").where("beyond is null or beyond <> component").join(at("left"), ["r", "c"], "left").join(at("right"), ["r", "c"], "left")
        same = lambda way: F.coalesce(F.col(way) == F.col("component"), F.lit(False))
        # ahead: nothing of the region on the left, so turn left around the own pixel; or go straight on; or turn right
        turn = F.when(~same("left"), 0).when(~same("right"), 1).otherwise(2)
        move = lambda k, s=s: F.when(turn == 0, F.lit(0)).when(turn == 1, F.lit(s["left"][k])).otherwise(F.lit(s["right"][k]))
        side = (i + F.when(turn == 0, 1).when(turn == 1, 0).otherwise(3)) % 4
        number_of = lambda r, c, k: number(r, c) * 4 + k
        found = near.select(
            "label", "component", number_of(F.col("r"), F.col("c"), F.lit(i)).alias("side"), number_of(F.col("r") + move(0), F.col("c") + move(1), side).alias("next"),
            (F.col("r") + s["start"][0]).alias("y"), (F.col("c") + s["start"][1]).alias("x"), F.lit(s["step"][0]).alias("dy"), F.lit(s["step"][1]).alias("dx"),
        )
        sides = found if sides is None else sides.unionByName(found)
    table = stash(sides)
    discard(own)
    state = stash(table.select("side", "next", F.least("side", "next").alias("low"), F.when(F.col("next") < F.col("side"), 1).otherwise(0).cast("long").alias("far"), F.lit(1).cast("long").alias("length")))
    # low: the smallest number among this side and the next `length`; far: steps to it
    state = _doubled(state)
    placed = table.join(large(state.select("side", "low", "far")), "side")
    length = placed.groupBy("low").agg(F.count("*").alias("size"), F.sum(-F.col("x") * F.col("dy")).alias("signed"))
    turns = table.select(F.col("next").alias("side"), F.col("dy").alias("dy0"), F.col("dx").alias("dx0"))
    corners = placed.join(large(turns), "side").where("dy <> dy0 or dx <> dx0")
    ordered = corners.groupBy("label", "component", "low").agg(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("k"), F.col("y").alias("r"), F.col("x").alias("c")))).alias("p"))
    points = F.transform("p", lambda q: F.struct(q["r"].alias("r"), q["c"].alias("c")))
    return ordered.join(large(length), "low").select("label", "component", F.col("low").alias("ring"), "size", "signed", points.alias("points"))


def _doubled(state: DataFrame) -> DataFrame:
    """Pointer doubling, a table each time, until no side learns of a smaller number."""
    while True:
        beyond = state.select(F.col("side").alias("s2"), F.col("next").alias("n2"), F.col("low").alias("low2"), F.col("far").alias("far2"), F.col("length").alias("length2"))
        met = state.join(large(beyond), F.col("next") == F.col("s2"))
        less = F.col("low2") < F.col("low")
        moved = met.select("side", F.col("n2").alias("next"), F.when(less, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(less, F.col("length") + F.col("far2")).otherwise(F.col("far")).alias("far"), (F.col("length") + F.col("length2")).alias("length"), less.alias("moved"))
        new, seen = stash_observed(moved, F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)).alias("n"))
        discard(state)
        state = new.drop("moved")
        state.stashed_at = new.stashed_at
        if not seen["n"]:
            return state
