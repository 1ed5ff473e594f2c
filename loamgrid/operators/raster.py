"""Grid operators on pixel tables (r, c, ...): neighbours, distances, components, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Offsets of the eight neighbours, in order.
OFFSETS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def across() -> WindowSpec:
    return Window.partitionBy("r").orderBy("c")


def down() -> WindowSpec:
    return Window.partitionBy("c").orderBy("r")


def up() -> WindowSpec:
    return Window.partitionBy("c").orderBy(F.desc("r"))


def boundary(pixels: DataFrame, label: str = "label") -> DataFrame:
    """pixels with `edge`: whether one of the four neighbours has another label; the scene's border, and a neighbour that is missing, is none."""
    next_to = lambda f, at, step: F.coalesce(f(at).over(across() if at == "c" else down()) == F.col(at) + step, F.lit(False))
    other = [next_to(f, at, step) & ~f(label).over(across() if at == "c" else down()).eqNullSafe(F.col(label)) for at in ("c", "r") for f, step in ((F.lag, -1), (F.lead, 1))]
    return pixels.withColumn("edge", other[0] | other[1] | other[2] | other[3])


def around(pixels: DataFrame, values: list[str]) -> DataFrame:
    """pixels with `around`: an array of (dr, dc, there, values) for all nine offsets, in order of rows, then columns; `there` tells
    whether the grid has that pixel. Neighbours come from windows along rows, then columns: two shuffles instead of a join for each."""
    own = F.struct(F.col("r"), F.col("c"), F.lit(True).alias("there"), *values)
    none = lambda x: x.withField("there", F.lit(False))

    def beside(value: Column, at: str, step: int) -> Column:
        w = across() if at == "c" else down()
        shifted = F.lag(value, -step).over(w)
        return F.when(F.coalesce(F.lag(F.col(at), -step).over(w) == F.col(at) + step, F.lit(False)), shifted)

    rows = pixels.withColumn("__own", own)
    rows = rows.withColumn("__row", F.array(*[F.coalesce(x, none(F.col("__own"))) for x in (beside(F.col("__own"), "c", -1), F.col("__own"), beside(F.col("__own"), "c", 1))]))
    # above and below: the rows of the pixels there, so a corner is known only where the pixel between is; a complete grid has them all
    absent = F.transform("__row", none)
    parts = [F.coalesce(beside(F.col("__row"), "r", dr) if dr else F.col("__row"), absent) for dr in (-1, 0, 1)]
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    met = F.zip_with(offsets, F.concat(*parts), lambda o, v: F.struct(o["dr"].alias("dr"), o["dc"].alias("dc"), *[v[n].alias(n) for n in ("there", *values)]))
    return rows.withColumn("around", met).drop("__own", "__row")


def boundary_distance(pixels: DataFrame, pixel_m: float = 10.0) -> DataFrame:
    """r, c, distance_m to the nearest edge pixel, exact if the grid is complete (masked pixels as rows), in two passes: rows to the nearest edge in the own column, by windows up
    and down; then, within each row, the smallest of squared column distance plus squared step. A row is one array, as wide as the
    scene; a pixel looks no further along it than its own first-pass distance, or at the whole row if its column has no edge. A
    map without edges has null distances."""
    marked = boundary(pixels).select("r", "c", F.when(F.col("edge"), F.col("r")).alias("at"))
    # both windows run: one that ends at the last row would be gone through anew for every pixel
    nearest = lambda way: F.last("at", True).over(way.rowsBetween(Window.unboundedPreceding, 0))
    first = marked.select("r", "c", F.least(F.col("r") - nearest(down()), nearest(up()) - F.col("r")).alias("g"))
    rows = first.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("row"))

    def best(x: Column, i: Column) -> Column:
        low = F.greatest(i + 1 - x["g"], F.lit(1))
        near = F.when(x["g"].isNull(), F.col("row")).otherwise(F.slice("row", low, i + 2 + x["g"] - low))
        squares = F.transform(near, lambda y: y["g"] * y["g"] + (y["c"] - x["c"]) * (y["c"] - x["c"]))  # null where there is no edge
        return F.struct(x["c"].alias("c"), F.round(F.sqrt(F.array_min(squares)) * pixel_m, 6).alias("distance_m"))

    return rows.select("r", F.explode(F.transform("row", best)).alias("x")).select("r", "x.c", "x.distance_m")


def mean_field(pixels: DataFrame, theta: float, steps: int, n_classes: int) -> DataFrame:
    """pixels: r, c, p (array of class probabilities). Each step adds theta times the neighbours' probabilities, weighted by 1 / distance,
    to the log of p and takes the softmax. A step is one shuffle: pixels send their probabilities to their neighbours."""
    unary = F.transform("p", lambda x: F.log(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-6))))
    state = pixels.select("r", "c", "p", F.col("p").alias("q"))
    for _ in range(steps):
        sent = state.select("r", "c", "q", F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit((dr * dr + dc * dc) ** -0.5).alias("w")) for dr, dc in OFFSETS])).alias("o"))
        sums = [F.sum(F.col("o.w") * F.col("q")[k]).alias(f"m{k}") for k in range(n_classes)]
        got = sent.groupBy((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).agg(*sums)
        score = F.zip_with(unary, F.array(*[F.coalesce(f"m{k}", F.lit(0.0)) for k in range(n_classes)]), lambda u, m: u + theta * m)
        state = state.drop("q").join(got, ["r", "c"], "left").withColumn("q", softmax(score)).select("r", "c", "p", "q")
    return state.select("r", "c", "q")


def softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))
