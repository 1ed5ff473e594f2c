"""Mixture-controlled packing: deficit round-robin over one queue for each source.

Documents are tokenized and cut into packets of at most one sequence. In every round a queue earns its share of the window's tokens
on top of the deficit that it carried over, and hands out packets as long as the deficit pays for them; what is left is carried to
the next round. A packet that ends at token e of its queue therefore leaves in round ceil(e / quantum) - 1, whatever the other
queues do, and the deficit of a queue is below one packet at any time. Rounds follow each other, and queues within a round: this
order is one stream of tokens, cut into sequences of `capacity` tokens. So every window of the stream holds the target proportions,
to a packet for each queue. A queue that has run dry drops out; rounds are then shorter, and the others keep their proportions.

The stream is cut without gaps, and what is left at its end is cut at powers of two, so no sequence is padded at all.

Places come from sums: of packets within hashed parts of a queue, of parts, of (round, queue) cells, and of blocks of rounds; each
is a shuffle by its key, and deficits go from partition to partition as these sums. Nothing depends on the number of sources.

Shares are given by source, or else are those of the corpus. A source without a given share, or with a share that isn't positive,
is an error. A null source is a queue of its own. A null or empty text is the end id alone; a null doc_id is packed like others.
Repeated rows are packed each. Very long texts are many packets. Ties don't matter: order within a queue is by hash of the row's
number. No rows give no rows. Columns other than doc_id, text and source are not read, of any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import as_bytes, discard, load, stash
from loamgrid.llm.packing import END_ID, default_tokenizer, token_ids

CAPACITY = 2048
#: Tokens of one round: 64 sequences.
WINDOW = 64 * CAPACITY
#: Packets of a queue's part, about, and rounds of a block; both only spread the sums over tasks.
PART, BLOCK = 8_192, 64

#: Rows of a batch within a task, so that little is held besides the tokenizer.
SOME = 128

PACKETS = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
PACKED = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("source", T.StringType()), T.StructField("round", T.LongType())])


def packets(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packets of each document; ids are little-endian, of 16 bits where all of a packet's fit. The row's number is fixed once this is a table."""

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=PACKETS.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(tokenizer_path).of
        rows: list[tuple] = []
        for batch in batches:
            for i in range(0, len(batch), SOME):
                part = batch.slice(i, SOME)
                for row, doc_id, source, text in zip(*(part.column(k).to_pylist() for k in range(3)), as_bytes(part.column(3)), strict=True):
                    ids = np.append(ids_of(text or b""), np.uint32(end_id)).astype("<u4", copy=False)
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        rows.append((row, doc_id, source, start, len(own), len(ids), own.astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes()))
                        if len(rows) == SOME:
                            yield table(rows)
                            rows = []
        yield table(rows)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text").mapInArrow(cut, PACKETS)


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def in_queues(cut: DataFrame) -> DataFrame:
    """row, source, start, length, end: where a packet ends in its queue. Lengths are summed within hashed parts of a queue, and over the parts before."""
    parts = max(1, -(-cut.count() // PART))
    dealt = cut.select("row", "source", "start", "length", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    within = Window.partitionBy("source", "part").orderBy("row", "start").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("own", F.sum("length").over(within))
    before = Window.partitionBy("source", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "part").agg(F.sum("length").alias("tokens")).withColumn("group", F.floor(F.col("part") / 1000))  # of a thousand parts, and of groups
    groups = sums.groupBy("source", "group").agg(F.sum("tokens").alias("tokens"))
    ahead = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    ahead = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("ahead"))
    firsts = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
    firsts = firsts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("before") + F.col("ahead")).alias("first"))
    met = own.join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return met.select("row", "source", "start", "length", (F.col("first") + F.col("own")).alias("end"))


def quanta(cut: DataFrame, window: int, shares: Mapping[str | None, float] | None) -> DataFrame:
    """source, quantum: tokens that a queue earns in a round."""
    tokens = cut.groupBy("source").agg(F.sum("length").alias("tokens"))
    if shares is None:
        return tokens.select("source", (F.lit(float(window)) * F.col("tokens") / _all(tokens)).alias("quantum"))
    if any(not share > 0 for share in shares.values()):
        raise ValueError("a share must be positive")
    given = cut.sparkSession.createDataFrame([(k, window * v / sum(shares.values())) for k, v in shares.items()], "s string, quantum double")
    met = stash(tokens.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "quantum"))
    if missing := met.where("quantum is null").head():
        raise ValueError(f"the source {missing['source']} has no share")
    return met


def _all(tokens: DataFrame) -> int:
    return tokens.agg(_total("tokens")).first()[0] or 1


def in_stream(queued: DataFrame, quantum: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, start, round, at: the round in which a packet leaves its queue, and its place in the stream. queued: a table."""
    own = quantum.select(F.col("source").alias("s"), "quantum")
    dealt = queued.join(own, F.col("source").eqNullSafe(F.col("s"))).select("row", "start", "source", "length", "end", F.floor((F.col("end") - 1) / F.col("quantum")).alias("round"))
    cells = stash(dealt.groupBy("round", "source").agg(F.sum("length").alias("tokens"), F.min(F.col("end") - F.col("length")).alias("first")).withColumn("block", F.floor(F.col("round") / block)))
    sums = cells.groupBy("block").agg(F.sum("tokens").alias("tokens"))
    ahead = sums.select("block", F.coalesce(F.sum("tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # one row for each block
    within = Window.partitionBy("block").orderBy("round", F.xxhash64("source"), "source").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(ahead, "block")
    placed = placed.select(F.col("round").alias("r"), F.col("source").alias("s"), (F.col("ahead") + F.col("before") - F.col("first")).alias("shift"))
    met = dealt.join(placed, (F.col("round") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    return met.select("row", "start", "round", (F.col("shift") + F.col("end") - F.col("length")).alias("at"))


def bounds(total: int, capacity: int) -> np.ndarray:
    """Where the sequences after the last full one begin, and the end of the stream: what is left is cut at powers of two."""
    left = total % capacity
    sizes = [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    return total - left + np.cumsum([0, *sizes])


def _seated(total: int, capacity: int):
    edges = bounds(total, capacity)

    def sequence(at: int) -> tuple[int, int, int]:
        """Number, begin and end of the sequence that holds this place."""
        if at < edges[0]:
            return at // capacity, at - at % capacity, at - at % capacity + capacity
        i = int(np.searchsorted(edges, at, "right")) - 1
        return total // capacity + i, int(edges[i]), int(edges[i + 1])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, SOME) for whole in batches for i in range(0, len(whole), SOME)):
            out: list[list] = [[] for _ in PACKED]
            for doc_id, source, start, length, doc_tokens, ids, turn, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "start", "length", "doc_tokens", "ids", "round", "at")), strict=True):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4").tobytes()
                done = 0
                while done < length:
                    number, begin, end = sequence(at + done)
                    n = min(length - done, end - at - done)
                    row = (doc_id, start + done, n, zlib.crc32(ids[4 * done : 4 * (done + n)]), doc_tokens, number, at + done - begin, source, turn)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    done += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(out, PACKED, strict=True)], names=PACKED.names)

    return seat


def mix(docs: DataFrame, tokenizer_path: str | None = None, shares: Mapping[str | None, float] | None = None, capacity: int = CAPACITY, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their sequence and offset, and the source and round that they left in."""
    cut = stash(packets(docs, tokenizer_path or default_tokenizer(), capacity, end_id))
    queued = stash(in_queues(cut))
    total = queued.agg(_total("length")).first()[0]
    placed = stash(in_stream(queued, quanta(queued, window, shares)))
    discard(queued)
    return cut.join(placed, ["row", "start"]).mapInArrow(_seated(total, capacity), PACKED)


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))
