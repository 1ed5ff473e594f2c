"""Best-fit packing by large-item matching.

Documents are cut into pieces of at most `capacity` tokens. Pieces above one third of the capacity pair at most twice per
sequence by greedy matching, each with the tightest gap beside a single large piece; smaller pieces then best-fit the gaps
that remain. As lengths are whole numbers up to the capacity, the packing is planned on the histogram of lengths, whose
size the capacity bounds however many documents there are; the plan says for ranges of equally long pieces which range of
sequences takes them, and every piece finds its place by its number among the pieces of its length.

A null or empty text has only the end id: one piece of length 1. Repeated rows are packed each, and so are rows without an id. Pieces
of equal length are interchangeable, so ties need no order. Only doc_id and text are read, whatever other columns there are. No rows
give no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loamgrid.llm.common import as_bytes, load, stash
from loamgrid.llm.ranks import numbered

CAPACITY = 4096
END_ID = 1
#: Entries that a Python worker's cache of tokenized words keeps; words beyond it are tokenized each time.
TOKEN_CACHE = 300_000
#: Documents that are tokenized at once, so that little is held besides the tokenizer.
SOME = 128

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
PACKED = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


#: The tokenizer's split pattern, over texts of ASCII and Latin-1 letters in lower case.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\t\\n\\v\\f\\ra-z0-9ß-öø-ÿ]+")
#: What such texts don't hold: other characters, and the strings of special tokens.
OTHER = re.compile("[^\\x00-\\x7fÀ-ÿ]|<\\|")


@cache
def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class PartIds(dict):
    """A part of a text, as the tokenizer splits it, to its ids as little-endian 32-bit bytes."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model, self.signs = tokenizer.model, _byte_signs()

    def __missing__(self, part: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize("".join([self.signs[b] for b in part.encode()]))], "<u4").tobytes()
        if len(self) < TOKEN_CACHE:
            self[part] = ids
        return ids


class Ids:
    """Token ids of texts, without special tokens. Parts are tokenized once and kept; a text with characters beyond Latin-1
    letters goes through the tokenizer word by word, as its patterns never match across white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = PartIds(self.tokenizer)

    def of(self, text: bytes) -> np.ndarray:
        plain = text.decode()
        if OTHER.search(plain):
            codes = self.tokenizer.encode_batch_fast([w.decode() for w in text.split()], add_special_tokens=False)
            return np.array([i for c in codes for i in c.ids], "<u4")
        return np.frombuffer(b"".join(map(self.parts.__getitem__, PARTS.findall(plain.lower()))), "<u4")


@cache
def token_ids(path: str) -> Ids:
    """One for each Python worker."""
    return Ids(path)


def _cut(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(tokenizer_path).of
        for batch in (whole.slice(i, SOME) for whole in batches for i in range(0, len(whole), SOME)):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = np.append(ids_of(text or b""), np.uint32(end_id)).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=PIECES.names[: len(kinds)])

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of each document, with their ids if asked for."""
    schema = PIECES if with_ids else T.StructType(PIECES.fields[:5])
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer_path, capacity, end_id, with_ids), schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, end number, first sequence, offset), sorted, for so many pieces of each length."""
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # gap: ranges [first sequence, count]
    order: list[int] = []  # the gaps, sorted
    made = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append([first, n])

    def fill(length: int, at: int, first: int, n: int, gap: int, times: int) -> int:
        """n sequences with this gap get `times` pieces each, numbered from at on; returns the next number."""
        for i in range(times):
            rows.append((length, at, at + n, first, capacity - gap + i * length))
            at += n
        return at

    def place(length: int, n: int, most: int) -> list[tuple[int, int, int]]:
        """Puts n pieces into the tightest gaps, at most `most` in one, and opens sequences for the rest; returns (gap left, first, count)."""
        nonlocal made
        at, left = 0, []
        while at < n:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                gap = order[i]
                first, there = gaps[gap].pop()
            else:
                gap, first, there = capacity, made, n
            times = min(most, gap // length)
            full = min(there, (n - at) // times)
            used = full + (full < there and full * times < n - at)
            if full:
                at = fill(length, at, first, full, gap, times)
                left.append((gap - times * length, first, full))
            if used > full:
                rest = n - at
                at = fill(length, at, first + full, 1, gap, rest)
                left.append((gap - rest * length, first + full, 1))
            if i < len(order):
                if there > used:
                    gaps[gap].append([first + used, there - used])
                elif not gaps[gap]:
                    del gaps[gap]
                    order.pop(i)
            else:
                made += used
            if most > 1:  # small pieces go on filling what they leave
                for x in left:
                    put(*x)
                left = []
        return left

    lengths = sorted(counts, reverse=True)
    done: list[tuple[int, int, int]] = []
    for length in (x for x in lengths if 2 * x > capacity):
        for x in place_alone(rows, length, counts[length], capacity, made):
            put(*x)
        made += counts[length]
    for length in (x for x in lengths if 2 * x <= capacity < 3 * x):
        n, at = counts[length], 0
        while at < n and (i := bisect.bisect_left(order, length)) < len(order):  # beside one large piece
            gap = order[i]
            first, there = gaps[gap].pop()
            take = min(there, n - at)
            at = fill(length, at, first, take, gap, 1)
            done.append((gap - length, first, take))
            if there > take:
                gaps[gap].append([first + take, there - take])
            elif not gaps[gap]:
                del gaps[gap]
                order.pop(i)
        pairs, one = divmod(n - at, 2)
        if pairs:
            at = fill(length, at, made, pairs, capacity, 2)
            done.append((capacity - 2 * length, made, pairs))
            made += pairs
        if one:
            at = fill(length, at, made, 1, capacity, 1)
            put(capacity - length, made, 1)
            made += 1
    for x in done:
        put(*x)
    for length in (x for x in lengths if 3 * x <= capacity):
        place(length, counts[length], capacity)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place_alone(rows: list, length: int, n: int, capacity: int, first: int) -> list[tuple[int, int, int]]:
    """More than half the capacity: each piece opens a sequence."""
    rows.append((length, 0, n, first, 0))
    return [(capacity - length, first, n)]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: a stored table of pieces. The histogram has at most `capacity` rows; the plan depends on it alone and is sent to all tasks."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    shift = np.int64(40)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        starts = (rows[:, 0] << shift) + rows[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__number"))
            row = rows[np.searchsorted(starts, (length << shift) + number, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PACKED.names[:5]), pa.array(row[:, 3] + number - row[:, 1]), pa.array(row[:, 4])], names=PACKED.names)

    known = numbered(cut.select(*PACKED.names[:5]), ["length"], [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], "__number", nulls=False)
    return known.mapInArrow(seat, PACKED)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stash(pieces(load(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)))
