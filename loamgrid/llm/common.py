"""What the text operators share: loading, tables in the shared folder, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.stored import discard, shared_folder, stash, stash_observed  # noqa: F401

#: Entries that a Python worker's word cache keeps. Words beyond it are hashed anew each time, with the same result.
WORD_CACHE = 250_000

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


#: Rows of a batch between Spark and Python: long texts fill memory by batches.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver's; from now on the session's batches are small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A sieve's largest size in 64-bit words (16 MB), and its bits for each value while it is below that.
SIEVE_WORDS, SIEVE_BITS = 1 << 21, 16


class Sieve:
    """A Bloom filter of bounded size over 64-bit values: it finds all of them, and a few others that an exact join must remove."""

    def __init__(self, values: DataFrame):
        """values: one column of longs, without null."""
        size = 1
        while size < SIEVE_WORDS and size * 64 < SIEVE_BITS * values.count():
            size *= 2

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, bit = (np.concatenate(x) for x in zip(*_sieve_places(batch.column(0).to_numpy(zero_copy_only=False), size), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

        rows = values.mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # `size` rows at most
        self.words = np.zeros(size, np.uint64)
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def test(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for word, bit in _sieve_places(values, len(self.words)):
            found &= self.words[word] & bit != 0
        return found


def _sieve_places(values: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h = values.view(np.uint64)
    for i in range(3):
        h = mix(h + np.uint64(i))
        yield ((h >> np.uint64(8)) % np.uint64(size)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHashes(dict):
    """word (bytes) to its 64-bit hash. bytes.split() without arguments gives the words [^\\x20\\x09-\\x0D]+, bytes.lower() lower-cases A-Z only."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes of a text that are hashed at once.
BLOCK = 1 << 16
SPACES = b" \t\n\v\f\r"
STEP = np.uint64(0x9E3779B97F4A7C13)


@cache
def _byte_tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and powers of STEP and of its inverse."""
    value = np.array([xxhash.xxh3_64_intdigest(b"byte %d" % i) for i in range(256)], np.uint64)
    value[list(SPACES)] = 0
    powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64)
    return value, powers(STEP), powers(np.uint64(pow(int(STEP), -1, 1 << 64)))


def _hash_block(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words."""
    size = len(text)
    value, power, inverse = _byte_tables(BLOCK if size <= BLOCK else 1 << (size - 1).bit_length())
    at = np.frombuffer(text, np.uint8)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = (at != 32) & ((at - np.uint8(9)) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(np.take(value, at, mode="clip") * power[:size], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def hash_texts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """hash_words of each text; short ones are hashed together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1:
            yield hash_words(texts[at])
        else:
            group = texts[at:end]
            h, start = _hash_block(b" ".join(group).lower())
            cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in group])).tolist()
            first = 0
            for cut in cuts:
                yield h[first:cut]
                first = cut
        at = end


def blocks(text: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about BLOCK bytes that cut no word."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in SPACES)
            if cut < 0:  # a word longer than the block
                cut = min((i for c in SPACES if (i := text.find(c, end)) >= 0), default=len(text) - 1)
            end = cut + 1
        yield at, min(end, len(text))
        at = end


def hash_words(text: bytes, lower: bool = True) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, in order, A-Z lower-cased if asked for: polynomials of their bytes, all at once."""
    if lower:
        text = text.lower()
    if len(text) <= BLOCK:
        return _hash_block(text)[0]
    return np.concatenate([_hash_block(text[at:end])[0] for at, end in blocks(text)])


def masked_words(text: bytes, field: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a text, in order; a word with a digit has the hash `field`."""
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, end in blocks(text):
        part = text[at:end]
        h, start = _hash_block(part)
        digits = np.flatnonzero(np.frombuffer(part, np.uint8) - np.uint8(48) < 10)
        h[np.searchsorted(start, digits, side="right") - 1] = field
        hashes.append(h)
        starts.append(start + at)
    return np.concatenate(hashes), np.concatenate(starts)


@cache
def word_hashes() -> WordHashes:
    """One for each Python worker."""
    return WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


@cache
def _weights(n: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % i) | 1) for i in range(n)]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row; of all words as one if there are fewer; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k))
    for i, weight in enumerate(_weights(k)):
        total += words[i : len(words) - k + 1 + i] * weight
    return mix(total)


def distinct(h: np.ndarray) -> np.ndarray:
    """The values of h once each, sorted."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
