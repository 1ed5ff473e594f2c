"""Feature collections, manifests and SQL scripts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<array<array<double>>>"
QUERY_WORDS = ("SELECT", "WITH", "TABLE", "VALUES")


def features(texts: DataFrame, properties: str) -> DataFrame:
    """One row for each feature of the collections in column `text`: its properties (names in lower case) and its rings.
    properties: their types as DDL. A text with an error payload, or without features in any text, is an error."""
    schema = f"error string, features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: {RING}>>>"
    read = texts.select(F.from_json("text", schema).alias("x"))
    checked = read.select(F.when(F.col("x.error").isNotNull(), F.raise_error(F.concat(F.lit("the service answered with an error: "), F.col("x.error")))).otherwise(F.col("x.features")).alias("features"))
    if not checked.where(F.size("features") > 0).head(1):
        raise ValueError("no text has a feature")
    rows = checked.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("rings"))
    return rows.toDF(*[c.lower() for c in rows.columns])


def collections(df: DataFrame, page: int, order: str) -> DataFrame:
    """df (columns properties: struct, rings) as pages of feature collections, `page` features each, by ranges of the ordering column."""
    feature = F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"))
    paged = df.groupBy(F.floor(F.col(order) / page).alias("page")).agg(F.collect_list(feature).alias("features"))
    return paged.select("page", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, of several lines, as one row."""
    return spark.read.option("multiLine", True).json(path)


def statements(script: str) -> list[tuple[str, str]]:
    """(title, statement) of a script, cut at semicolons. The title is the first line of the comments right above the code, so that
    what stands further up, as the head of a file, isn't taken for it; `query` where there are none."""
    found = []
    for part in script.split(";"):
        lines = [x.strip() for x in part.strip().splitlines()]
        first = next((i for i, x in enumerate(lines) if x and not x.startswith("--")), None)
        if first is not None:
            above = first
            while above and lines[above - 1].startswith("--"):
                above -= 1
            found.append((lines[above].lstrip("-").strip() if above < first else "query", "\n".join(lines)))
    return found


def is_query(statement: str) -> bool:
    """Whether a statement returns rows."""
    code = next((x.strip() for x in statement.splitlines() if x.strip() and not x.strip().startswith("--")), "")
    return code.upper().startswith(QUERY_WORDS)


def run_script(spark: SparkSession, script: str) -> list[tuple[str, DataFrame | None]]:
    """(title, rows) of each statement in order; None where a statement returns none."""
    out = []
    for title, statement in statements(script):
        frame = spark.sql(statement)
        out.append((title, frame if is_query(statement) else None))
    return out
