"""Maps smoothed at several thetas, told by the same figures, and the theta that is chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import measures, regions, smoothing
from loamgrid.stored import stash

#: The thetas, steps, smallest area of a polygon in m2, area of a pixel in m2, and the class of built-up land.
THETAS, STEPS = (0.3, 0.8, 2.0, 5.0, 12.0), 8
LEAST_AREA, PIXEL_AREA, BUILT = 2000, 100, 1


def evaluate(maps: DataFrame, truth: DataFrame, thin: DataFrame) -> DataFrame:
    """maps: theta, r, c, label (0: none); truth: r, c, truth (0 or null: none), of valid pixels; thin: r, c. For each theta: pixels,
    accuracy, kappa and macro_f1 over the classes of the truth, built_km2, retention of thin structures, regions of LEAST_AREA or more, and what the smaller ones cover.
    The regions of all maps are found at once, the maps laid below each other with a row between."""
    thetas = sorted(r[0] for r in maps.select("theta").distinct().collect())  # one row for each theta
    height = (maps.agg(F.max("r")).first()[0] or 0) + 2
    place = F.array_position(F.array(*map(F.lit, thetas)), F.col("theta")) - 1
    met = maps.join(truth.where("truth <> 0"), ["r", "c"])
    seen = measures.counts(met, ["theta"], pred="label")
    classes = sorted(r[0] for r in seen.select("truth").distinct().collect())  # a class scheme
    figures = measures.accuracy_by(seen, ["theta"]).withColumnRenamed("n", "pixels").join(measures.overall(seen, classes, ["theta"]).select("theta", "kappa", "macro_f1"), "theta", "left")
    built = maps.groupBy("theta").agg((F.sum((F.col("label") == BUILT).cast("long")) * PIXEL_AREA / 1e6).alias("built_km2"))
    kept = maps.join(thin, ["r", "c"]).groupBy("theta").agg(F.avg((F.col("label") == BUILT).cast("double")).alias("retention"))
    laid = maps.where("label <> 0").select((F.col("r") + place * height).cast("int").alias("r"), "c", "label")
    patches = regions.region_runs(laid).groupBy("component").agg((F.sum("n") * PIXEL_AREA).alias("area"), F.min("r").alias("r"))
    back = F.element_at(F.array(*map(F.lit, thetas)), (F.floor(F.col("r") / height) + 1).cast("int")).alias("theta")
    small = F.col("area") < LEAST_AREA
    found = patches.select(back, "area").groupBy("theta").agg(F.sum((~small).cast("long")).alias("polygons"), F.sum(small.cast("long")).alias("dropped"), (F.sum(F.when(small, F.col("area")).otherwise(0)) / 1e6).alias("dropped_km2"))
    return built.join(figures, "theta", "left").join(kept, "theta", "left").join(found, "theta", "left")


def sweep(pixels: DataFrame, truth: DataFrame, thin: DataFrame, sigma: float, class_ids: Sequence[int], n_features: int, thetas: Sequence[float] = THETAS, steps: int = STEPS) -> DataFrame:
    """variant, theta, chosen and the figures of evaluate: the contrast-weighted maps, and at the chosen theta one with uniform weights."""

    def maps(some: Sequence[float], width: float | None) -> DataFrame:
        smoothed = smoothing.smooth(pixels, some, width, steps, len(class_ids), n_features)
        return stash(smoothed.select("theta", "r", "c", smoothing.decoded(F.col("q"), class_ids).alias("label")))

    figures = stash(evaluate(maps(thetas, sigma), truth, thin))
    theta = smoothing.chosen(figures).first()["theta"]
    plain = evaluate(maps([theta], None), truth, thin)
    marked = figures.select(F.lit("contrast").alias("variant"), (F.col("theta") == theta).alias("chosen"), "*")
    return marked.unionByName(plain.select(F.lit("uniform").alias("variant"), F.lit(False).alias("chosen"), "*"))
