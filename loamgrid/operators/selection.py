"""Order statistics and ranks of tables of any size: no task sees all values.

Percentiles are exact. Numbers are taken as 64-bit patterns whose unsigned order is theirs; histograms of 16 bits at a time, each of
65,536 rows at most for a group, narrow every sought rank down to one value in four passes. Nulls and NaN don't count; a group
without numbers is left out; without groups there is one row, of nulls if there is no number.

Ranks come from ranges of a draw: rows are numbered within ranges, and ranges start where those before them end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.stored import discard, stash

BITS, DIGIT = 64, 16
#: Ranges that a draw is dealt into, in bits.
RANGES = 10


def _flipped(bits: np.ndarray, back: bool) -> np.ndarray:
    """64-bit patterns of doubles to ones in unsigned order, or back."""
    top = np.uint64(1 << 63)
    positive = (bits & top != 0) if back else (bits & top == 0)
    return np.where(positive, bits ^ top, ~bits)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, doubles, becomes keys."""
    for batch in batches:
        values = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) + 0.0  # -0 is 0
        keys = pa.array(_flipped(np.ascontiguousarray(values).view(np.uint64), False).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], keys], names=[*batch.schema.names[:-1], "key"])


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_flipped(bits, True).view(np.float64))], names=[*batch.schema.names[:-1], "value"])


def percentiles(df: DataFrame, column: Column | str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by and p0, p1, ...: the value at each share of the way from the smallest to the largest, between two values in proportion."""
    by = list(by)
    known = df.select(*by, (F.col(column) if isinstance(column, str) else column).cast("double").alias("key")).where("key is not null and not isnan(key)")
    values = stash(known.mapInArrow(_keyed, T.StructType([*known.schema.fields[:-1], T.StructField("key", T.LongType())])))
    same = lambda one, other, names: [one[n].eqNullSafe(other[n]) for n in names]
    counts = values.groupBy(*by).agg(F.count("*").alias("n"))
    spots = F.array(*[F.struct(F.lit(i).alias("share"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(shares)])
    sought = stash(counts.where("n > 0").select(*by, F.explode(spots).alias("x")).select(*by, "x.share", "x.at"))
    ranks = sought.select(*by, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    state = ranks.select(*by, "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(BITS // DIGIT):
        digit = F.shiftrightunsigned("key", BITS - DIGIT * (level + 1)).bitwiseAND((1 << DIGIT) - 1)
        if level:
            here = values.withColumn("prefix", F.shiftrightunsigned("key", BITS - DIGIT * level))
            open_ = state.select(*by, "prefix").distinct()
            here = here.join(open_, same(here, open_, [*by, "prefix"]), "left_semi")
        else:
            here = values.withColumn("prefix", F.lit(0).cast("long"))
        histogram = here.groupBy(*by, "prefix", digit.alias("digit")).agg(F.count("*").alias("rows"))
        upto = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        steps = histogram.withColumn("end", F.sum("rows").over(upto)).withColumn("begin", F.col("end") - F.col("rows"))
        names = [F.col(f"s.{n}").eqNullSafe(F.col(f"h.{n}")) for n in [*by, "prefix"]]
        met = state.alias("s").join(steps.alias("h"), [*names, F.col("s.left") >= F.col("h.begin"), F.col("s.left") < F.col("h.end")])
        before, state = state, stash(met.select(*[f"s.{n}" for n in [*by, "rank"]], (F.col("s.left") - F.col("h.begin")).alias("left"), (F.shiftleft("s.prefix", DIGIT) + F.col("h.digit")).alias("prefix")))
        if level:
            discard(before)
    found = state.select(*by, "rank", "prefix").mapInArrow(_valued, T.StructType([*[df.schema[n] for n in by], T.StructField("rank", T.LongType()), T.StructField("value", T.DoubleType())]))
    low, high = found.alias("a"), found.alias("b")
    keys = lambda t: [F.col(f"s.{n}").eqNullSafe(F.col(f"{t}.{n}")) for n in by]
    ends = sought.alias("s").join(low, [*keys("a"), F.floor("s.at") == F.col("a.rank")]).join(high, [*keys("b"), F.ceil("s.at") == F.col("b.rank")])
    value = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("s.at") - F.col("a.rank"))
    wide = ends.groupBy(*[F.col(f"s.{n}").alias(n) for n in by]).agg(*[F.max(F.when(F.col("s.share") == i, value)).alias(f"p{i}") for i in range(len(shares))])
    result = stash(wide)
    discard(values, sought, state)
    return result


def draw(*columns: str, seed: int) -> Column:
    """63 bits for each row, the same wherever the row lies."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 1)


def ranked(df: DataFrame, by: Column, ties: Sequence[str], name: str = "rank", bits: int = 63) -> DataFrame:
    """df with ranks from 1 by a draw of so many bits, then ties, which must be distinct."""
    part = F.shiftright(by, max(0, bits - RANGES)).alias("__part")
    dealt = df.withColumn("__draw", by).withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy("__draw", *ties)
    return dealt.join(starts, "__part").withColumn(name, F.col("__start") + F.row_number().over(within)).drop("__part", "__draw", "__start")


def first_rows(df: DataFrame, n: int, by: Column, ties: Sequence[str], bits: int = 63) -> DataFrame:
    """The n rows that come first by a draw, then ties: whole ranges, and the first rows of the range that the last one lies in."""
    part = F.shiftright(by, max(0, bits - RANGES))
    taken, cut, rest = 0, None, 0
    for p, rows in sorted(tuple(r) for r in df.groupBy(part.alias("part")).count().collect()):  # one row for each range
        if taken + rows > n:
            cut, rest = p, n - taken
            break
        taken += rows
    if cut is None:
        return df
    return df.where(part < cut).unionByName(df.where(part == cut).orderBy(by, *ties).limit(rest))
