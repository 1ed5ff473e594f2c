"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

An item of n shingles is contained in a document that has at least `threshold` of them, so the document lacks at most
n - ceil(threshold * n). Items are partitioned by the length of their shingles and by n, in powers of two. Each partition has a
candidate threshold h, which grows with its size: an item's signature is the bottom of its min-hash order, h shingles more than it
may lack, so that a document that contains the item has at least h of them, whatever its own length. Items with h hits are
candidates, and only their shingles are all looked up and counted. The search thus loses nothing.

Words are lower-cased, and punctuation, also within words, counts as white space. Items of fewer words than a shingle are found by
runs of their own number of words, anywhere in a document; documents of fewer words contain only these. Null and wordless texts
match nothing and are kept. Benchmark items are taken in blocks of a fixed number of shingles, so what is sent to the tasks has that
bound and the documents are read once for each block. Repeated rows, of documents or items, give repeated matches, rows without
an id give matches without one; ties need no order. Texts of any length are searched whole. Without documents or items there are no matches. Further columns of any name are
handed on by drop_contaminated and not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import as_bytes, distinct, hash_texts, load, windows

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of benchmark items that are sent to the tasks at once (12 bytes each).
BLOCK = 2_000_000

#: Punctuation becomes white space, so that marks glued to words do not hide a passage.
PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
MATCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("item_shingles", T.LongType()), T.StructField("shared_shingles", T.LongType()), T.StructField("containment", T.DoubleType())])


def words_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    return hash_texts([t.translate(PLAIN) for t in texts])


def shingles(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each text, hashes of the distinct shingles, sorted; a shorter text is one shingle."""
    return (distinct(windows(words, n)) for words in words_of(texts))


def most_lacking(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9)


def candidate_hits(n: int) -> int:
    """Signature hits that make a candidate, by the partition of items of n shingles."""
    return 1 + n.bit_length() // 3


class Partition:
    """Items with shingles of one length and numbers of shingles between two powers of two."""

    def __init__(self, items: list[tuple], threshold: float):
        """items: item_id, shingles."""
        self.ids = [i for i, _ in items]
        self.items = [s for _, s in items]
        self.least = np.array([len(s) - most_lacking(len(s), threshold) for s in self.items], np.int64)
        # no more hits are asked for than the least that a containing document has
        self.hits = np.minimum([candidate_hits(len(s)) for s in self.items], self.least)
        # shingles are sorted by hash, so a signature is the first few
        own = [s[: len(s) - least + h] for s, least, h in zip(self.items, self.least.tolist(), self.hits.tolist(), strict=True)]
        every, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(every, kind="stable")
        self.signature, self.owner = every[order], owner[order]

    def search(self, own: np.ndarray) -> Iterator[tuple]:
        """(item, its shingles, those shared) of the items that a document with these shingles contains."""
        first = np.searchsorted(self.signature, own, "left")
        met = np.flatnonzero(self.signature[np.minimum(first, len(self.signature) - 1)] == own)
        if not len(met):
            return
        first, last = first[met], np.searchsorted(self.signature, own[met], "right")
        hits = np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]), minlength=len(self.ids))
        for i in np.flatnonzero(hits >= self.hits).tolist():
            item = self.items[i]
            shared = int((own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item).sum())
            if shared >= self.least[i]:
                yield self.ids[i], len(item), shared


class Index:
    """The partitions of a block of items (item_id, length of shingles, shingles)."""

    def __init__(self, items: list[tuple], n: int, threshold: float):
        by: dict[tuple[int, int], list] = {}
        for item_id, length, own in items:
            by.setdefault((length, len(own).bit_length()), []).append((item_id, own))
        self.n, self.partitions = n, [(length, Partition(x, threshold)) for (length, _), x in sorted(by.items(), key=lambda x: x[0])]

    def search(self, words: np.ndarray) -> list[tuple]:
        found, own = [], {}
        for length, partition in self.partitions:
            if len(words) >= length:
                if length not in own:
                    own[length] = distinct(windows(words, length))
                found += partition.search(own[length])
        return found


def _items(n: int):
    """From item_id, text: the length of its shingles, and them; not of wordless ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, min(n, len(w)), distinct(windows(w, n))) for i, w in zip(batch.column(0).to_pylist(), words_of([t or b"" for t in as_bytes(batch.column(1))]), strict=True) if len(w)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int32()), pa.array([x[2].view(np.int64) for x in own], pa.list_(pa.int64()))], names=["item_id", "length", "shingles"])

    return read


def _blocks(benchmark: DataFrame, n: int, block: int) -> Iterator[list[tuple]]:
    """The items, in blocks of so many shingles; one block is held at a time."""
    items: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text").mapInArrow(_items(n), "item_id long, length int, shingles array<long>").toLocalIterator():
        own = np.array(row["shingles"], np.int64).view(np.uint64)
        if items and size + len(own) > block:
            yield items
            items, size = [], 0
        items.append((row["item_id"], row["length"], own))
        size += len(own)
    if items:
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row for each document and item that it contains. No shuffle."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], MATCHES)
    for items in _blocks(benchmark, n, block):
        index = spark.sparkContext.broadcast(Index(items, n, threshold))

        def match(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = words_of([t or b"" for t in as_bytes(batch.column(1))])
                rows = [(i, item, size, shared, shared / size) for i, w in zip(batch.column(0).to_pylist(), own, strict=True) for item, size, shared in index.value.search(w)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=MATCHES.names)

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(match, MATCHES))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, n, block):
        index = spark.sparkContext.broadcast(Index(items, n, threshold))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = words_of([t or b"" for t in as_bytes(batch.column("text"))])
                yield batch.filter(pa.array([not index.value.search(w) for w in own], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
