"""Gapless numbers within a key, without one task for a key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that each key's rows are dealt into by hash.
SALTS = 256


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str, salts: int = SALTS, nulls: bool = True) -> DataFrame:
    """df with column name: 0, 1, ... within each key. Rows are numbered within hashed parts of a key, and each part starts
    where the counts of the parts before it end; a key that holds most rows is spread over all parts. Rows that are equal
    in all of order are interchangeable. Null keys form a key of their own; without any (nulls: False) the rows are dealt out and
    sorted once, for the numbers and for the join with the parts' starts alike."""
    salt, first, place = "__salt", "__first", "__place"
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*key, salt).count().select(*[F.col(k).alias(f"__{k}") for k in key], F.col(salt).alias("__salt2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    own = dealt.withColumn(place, F.row_number().over(Window.partitionBy(*key, salt).orderBy(*order)) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) if nulls else F.col(k) == F.col(f"__{k}") for k in key]
    return own.join(starts, reduce(and_, [*same, F.col(salt) == F.col("__salt2")])).withColumn(name, (F.col(first) + F.col(place)).cast("long")).drop(salt, "__salt2", first, place, *[f"__{k}" for k in key])
