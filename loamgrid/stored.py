"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="loamgrid-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session, as in tests, may leave it unset and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file://{_own_folder()}"


#: Rows of a file, where their number is known beforehand.
FILE_ROWS = 100_000


def stash(df: DataFrame, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: cuts lineage, survives lost executors. rows: a bound of its
    rows, if there is one, so that a small table isn't written by every shuffle partition."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // file_rows)))
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/loamgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stashed_at = path
    return table


def stash_observed(df: DataFrame, *values: Column, rows: int | None = None) -> tuple[DataFrame, dict]:
    """A stored table, and aggregates of its rows that the same job works out."""
    seen = Observation()
    table = stash(df.observe(seen, *values), rows)
    return table, seen.get


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stashed_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
