"""Features of a paged service as a Spark source.

`spark.read.format("feature_pages").option("address", "https://host/query?offset={offset}&count={count}&envelope={envelope}")
.option("fields", "ID bigint, Code string").load()` has the fields (in lower case), the rings, and the box x0, y0, x1, y1 of each feature.

The number of pages isn't known beforehand: each of `readers` partitions asks for every so many-th page and stops at its first short
one, so pages are fetched side by side and none twice. Comparisons with the box are pushed down as the envelope of the request
(x0,y0,x1,y1; -inf and inf where a side is open) and checked again on what the service sends. An error payload, an answer that isn't
a feature collection, and a service without any feature are errors; a page that can't be read is asked for again.
"""

from __future__ import annotations

import json
import math
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PAGE, READERS, TRIES = 1000, 4, 3
BOX = ("x0", "y0", "x1", "y1")


class Pages(InputPartition):
    def __init__(self, first: int):
        self.first = first


def fetch(address: str, tries: int = TRIES, pause: float = 0.5) -> dict:
    for k in range(tries):
        try:
            with urllib.request.urlopen(address, timeout=60) as answer:
                return json.load(answer)
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError("raised above")


def boxed(rings: list) -> tuple[float, float, float, float]:
    xs, ys = zip(*(p[:2] for ring in rings for p in ring), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields[:-5]]
        self.address, self.page, self.readers = options["address"], int(options.get("page", PAGE)), int(options.get("readers", READERS))
        self.low = {c: -math.inf for c in BOX}
        self.high = {c: math.inf for c in BOX}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in BOX and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low[column] = max(self.low[column], f.value)
            elif column in BOX and isinstance(f, LessThan | LessThanOrEqual):
                self.high[column] = min(self.high[column], f.value)
            yield f  # Spark checks all of them again

    def partitions(self) -> list[Pages]:
        return [Pages(i) for i in range(self.readers)]

    def envelope(self) -> str:
        """What a feature's box must meet: x1 and y1 from here on, x0 and y0 up to there."""
        return ",".join(str(x) for x in (self.low["x1"], self.low["y1"], self.high["x0"], self.high["y0"]))

    def read(self, partition: Pages) -> Iterator[tuple]:
        number = partition.first
        while True:
            answer = fetch(self.address.format(offset=number * self.page, count=self.page, page=number, envelope=self.envelope()))
            if "error" in answer:
                raise ValueError(f"the service answered with an error: {answer['error']}")
            if not isinstance(answer.get("features"), list):
                raise ValueError("the service answered with something else than a feature collection")
            features = answer["features"]
            if not number and not features:
                raise ValueError("the service has no feature")
            for feature in features:
                own = {k.lower(): v for k, v in (feature.get("properties") or {}).items()}
                for rings in _polygons(feature.get("geometry")):
                    box = boxed(rings)
                    if all(self.low[c] <= v <= self.high[c] for c, v in zip(BOX, box, strict=True)):
                        yield (*(own.get(n) for n in self.names), rings, *box)
            if len(features) < self.page:
                return
            number += self.readers


def _polygons(geometry: dict | None) -> list:
    """The rings of each polygon, as doubles."""
    if not geometry or not geometry.get("coordinates"):
        return []
    found = geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]
    return [[[[float(x) for x in p[:2]] for p in ring] for ring in rings] for rings in found]


class FeaturePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> str:
        return f"{self.options['fields'].lower()}, rings array<array<array<double>>>, {', '.join(f'{c} double' for c in BOX)}"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeaturePages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
