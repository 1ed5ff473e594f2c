"""Tables, summaries and reports written out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Factors of the overviews; widths and heads of the columns of a metrics report; rows of a result in a text report.
OVERVIEWS = (2, 4, 8, 16)
HEADS = (("precision", 10), ("recall", 9), ("f1", 8), ("support", 10))
REPORT_ROWS = 30


def write_raster(pixels: DataFrame, bands: list[str], path: str, tile: int = 512, facts: dict | None = None) -> None:
    """A raster as a table of tiles (r, c and bands; zstd), its overviews by average beside it, and its facts as one JSON row."""
    tiled = lambda df: df.withColumn("tile_r", F.floor(F.col("r") / tile)).withColumn("tile_c", F.floor(F.col("c") / tile))
    save = lambda df, name: tiled(df).repartitionByRange("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "r", "c").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    base = pixels.select("r", "c", *bands)
    save(base, "full")
    for factor in OVERVIEWS:
        place = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in ("r", "c")]
        save(base.groupBy(*place).agg(*[F.avg(b).alias(b) for b in bands]), f"overview_{factor}")
    write_summary(pixels.sparkSession.createDataFrame([(json.dumps({"bands": bands, "tile": tile, "overviews": OVERVIEWS, **(facts or {})}),)], "value string"), f"{path}/facts")


def write_scene(pixels: DataFrame, bands: list[str], path: str, facts: dict | None = None) -> None:
    """A scene: bands without what is invalid, the scene classes and validity, the histogram of the classes, and the pointer to it."""
    masked = pixels.select("r", "c", *[F.when(F.col("valid"), F.col(b)).alias(b) for b in bands])
    write_raster(masked, bands, f"{path}/stack", facts=facts)
    pixels.select("r", "c", "scl", "valid").write.mode("overwrite").parquet(f"{path}/scl")
    pixels.groupBy("scl").agg(F.count("*").alias("pixels")).write.mode("overwrite").json(f"{path}/histogram")
    write_summary(pixels.sparkSession.createDataFrame([(json.dumps({"latest": path}),)], "value string"), f"{path}/latest")


def write_variants(maps: DataFrame, path: str, column: str = "variant") -> None:
    """Prediction, probability or smoothed maps, a folder for each variant."""
    maps.write.mode("overwrite").partitionBy(column).option("compression", "zstd").parquet(path)


def spread_key(x: Column, y: Column, cell: float) -> Column:
    """The bits of two cell numbers in turn (16 each, counted from the cell -32,768), so that near places have near keys."""
    bits = lambda v: (F.floor(v / cell) + (1 << 15)).cast("long")

    def apart(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return apart(bits(x)).bitwiseOR(F.shiftleft(apart(bits(y)), 1))


def write_shapes(df: DataFrame, path: str, cell: float = 500.0, files: int | None = None) -> None:
    """Rows with a box (x0, y0, x1, y1) in the order of a space-filling key of its middle, so that files and row groups hold near
    shapes, and a window over the box columns prunes the others."""
    keyed = df.withColumn("__key", spread_key((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, cell))
    ranged = keyed.repartitionByRange(files, "__key") if files else keyed.repartitionByRange("__key")
    ranged.sortWithinPartitions("__key").drop("__key").write.mode("overwrite").option("parquet.block.row.count.limit", 20_000).parquet(path)


def read_window(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The shapes whose boxes meet a window."""
    return spark.read.parquet(path).where((F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1))


def write_table(df: DataFrame, name: str) -> None:
    """A table of the catalogue, replaced as a whole, with statistics of all its columns."""
    df.write.mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; a column `value` alone is written as it is."""
    lines = df if df.columns == ["value"] else df.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_script_constant(df: DataFrame, path: str, name: str = "DATA") -> None:
    """A JavaScript constant with the rows as JSON, one row to a line, each part complete in order."""
    rows = df.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value"))
    one = lambda text: df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    one(f"const {name} = [").unionByName(rows).unionByName(one("];")).write.mode("overwrite").text(path)


def metrics_text(per_class: list[dict], totals: dict) -> str:
    """A report of fixed width. per_class: name, precision, recall, f1, support; totals: macro_f1, weighted_f1, accuracy, kappa, n."""
    first = 2 + max(len(row["name"]) for row in per_class)
    rule = "-" * (first + sum(width for _, width in HEADS))
    shown = lambda x: f"{x:,}" if isinstance(x, int) else f"{x:.3f}"
    line = lambda head, cells: head.ljust(first) + "".join(cell.rjust(width) for cell, width in cells)
    lines = [line("class", HEADS), rule]
    lines += [line(row["name"], [(shown(row[head]), width) for head, width in HEADS]) for row in per_class]
    lines.append(rule)
    for head, key in (("macro F1", "macro_f1"), ("weighted F1", "weighted_f1"), ("overall accuracy", "accuracy"), ("Cohen's kappa", "kappa"), ("test pixels", "n")):
        lines.append(line(head, [(shown(totals[key]), HEADS[0][1] + HEADS[1][1] + HEADS[2][1])]))
    return "\n".join(lines)


def results_text(results: list[tuple[str, DataFrame | None]], rows: int = REPORT_ROWS) -> str:
    """Titles and first rows of results (None: a statement without rows); the limit is the report's feature."""
    shown = lambda df: "done" if df is None else df.limit(rows).toPandas().to_string(index=False)
    return "\n\n".join(f"{title}\n{'-' * len(title)}\n{shown(df)}" for title, df in results)
