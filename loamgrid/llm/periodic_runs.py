"""Periodic runs: stretches of words that repeat themselves at least three times, by comparing a text with itself at all lags.

A text is an array of word numbers. For every lag p up to a third of its words the array is compared with itself p words on; a
stretch where both are equal for max(24, 3 * p) - p words in a row is a run of period p. A run shows again at the multiples of its
period, with the same words, so of equal stretches that of the smallest lag stays.

Most lags have no such stretch. A sieve finds those that have one, and others seldom: a stretch is so long that some word at a
multiple of the step, a few words shorter, starts eight words that recur p words on. So all lags of an octave [p, 2 * p) are
compared at these words at once, and only lags that are found are compared as a whole and cut into stretches.

The work of a text is dealt by ranges of lags. A text of more than 3 * LAGS words is one row for each range, so that many tasks
share it; ranges of equal texts are scanned once, and their runs are joined with the text again. Others are one range, scanned
where they lie, without a shuffle.

A null or wordless text has no words, no runs, and the hash of an empty text. A row with a null doc_id is taken as it is (nothing
is planted into it). Repeated rows, and rows of one id, have a row each. Words are compared exactly. Columns other than doc_id and
text are not read, of any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import as_bytes, load, mix, stash

#: Fewest words of a run, and fewest periods.
LEAST, PERIODS = 24, 3
#: Lags of one range.
LAGS = 1 << 16
#: Words in a row that the sieve compares.
GRAM = 8
#: Lags that every range scans first, as they tell the sieve what it need not find again.
SMALL = 64

RUNS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")])
UNITS = T.StructType([T.StructField("digest", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("words", T.BinaryType())])
FOUND = T.StructType([T.StructField("digest", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "period")]])
Plant = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The stated repetition of one text in ten; words of any other text as they are."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def as_is(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def numbers(words: list[bytes]) -> np.ndarray:
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _needed(lag: int) -> int:
    """Words in a row that must be equal at this lag."""
    return max(LEAST, PERIODS * lag) - lag


def _stretches(words: np.ndarray, lag: int) -> np.ndarray:
    """Rows (start, length) of the runs at this lag."""
    differ = np.flatnonzero(words[lag:] != words[:-lag])
    edges = np.concatenate([[-1], differ, [len(words) - lag]])
    equal = np.diff(edges) - 1
    at = np.flatnonzero(equal >= _needed(lag))
    return np.stack([edges[at] + 1, equal[at] + lag], axis=1)


def scan(words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, lag) at the lags of [low, high); of equal stretches that of the smallest lag."""
    n = len(words)
    high = min(high, n // PERIODS + 1)
    if n < LEAST or low >= high:
        return []
    grams = mix(words.astype(np.uint64))
    for half in (1, 2, 4):
        grams = mix(grams[:-half] * np.uint64(3) + grams[half:])  # of 2, 4, 8 words in a row
    found: dict[tuple[int, int], int] = {}
    owner = np.full(n, -1, np.int64)  # of a word: the number of a run that has it
    known: list[tuple[int, int]] = []  # end and period of each run

    def look(first: int, end: int) -> None:
        """All lags of [first, end), end <= 2 * first."""
        step = max(LEAST - 2 * first + 1, 2 * first, LEAST - LEAST // PERIODS) - GRAM + 1
        samples = grams[: max(0, len(grams) - first) : step]
        width = end - first
        beyond = np.concatenate([grams, np.zeros(step + width, np.uint64)])  # zeros are compared, and told apart below
        rows = np.ndarray((len(samples), width), np.uint64, beyond, 8 * first, (8 * step, 8))
        at, lag = np.nonzero(rows == samples[:, None])
        at, lag = at * step, lag + first
        if not len(at):
            return
        real = at + lag < len(grams)
        own = owner[at]
        ends, periods = np.array([*known, (0, 1)], np.int64).T[:, own]
        real &= ~((own >= 0) & (lag % periods == 0) & (at + lag + GRAM <= ends))  # a multiple of a run's period, inside that run
        for p in np.unique(lag[real]).tolist():
            for start, length in _stretches(words, p).tolist():
                if (start, length) not in found:
                    found[start, length] = p
                    owner[start : start + length] = len(known)
                    known.append((start + length, p))

    for a, b in ((1, min(SMALL, low)), (low, high)):
        while a < b:
            look(a, min(2 * a, b))
            a *= 2
    return [(start, length, p) for (start, length), p in found.items() if p >= low]


def told(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of RUNS. runs: (start, length, period)."""
    runs = sorted(runs, key=lambda x: (x[0], x[2]))
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1])
    kept = b" ".join(w for w, d in zip(words, dropped.tolist(), strict=True) if not d) if runs else b" ".join(words)
    best: tuple | list = (None,) * 4
    for start, length, period in runs:
        if best[0] is None or length * best[2] > best[1] * period:  # the first of equals has the smallest start, then period
            best = (start, length, period, 1000 * length // period)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(RUNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(columns, RUNS, strict=True)], names=RUNS.names)


def _texts(batches: Iterator[pa.RecordBatch], plant: Plant) -> Iterator[tuple[int | None, list[bytes]]]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            yield doc_id, plant(doc_id, (text or b"").split())


def _whole(plant: Plant, rows: int = 200):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, words in _texts(batches, plant):
            out.append(told(doc_id, words, scan(numbers(words), 1, len(words))))
            if len(out) == rows:
                yield _rows(out)
                out = []
        yield _rows(out)

    return read


def _digest(words: list[bytes]) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def _units(plant: Plant, lags: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _texts(batches, plant):
            digest, ids = _digest(words), numbers(words).tobytes()
            for low in range(1, len(words) // PERIODS + 1, lags):
                yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([low], pa.int64()), pa.array([low + lags], pa.int64()), pa.array([ids], pa.binary())], names=UNITS.names)

    return read


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digest, low, high, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = np.array(scan(np.frombuffer(ids, np.int32), low, high), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([digest] * len(found), pa.string()), *(pa.array(found[:, i].copy()) for i in range(3))], names=FOUND.names)


def _keyed(plant: Plant):
    """doc_id, text and the digest of the text's words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(words) for _, words in _texts(iter([batch]), plant)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(digests, pa.string())], names=["doc_id", "text", "digest"])

    return read


def _joined(plant: Plant):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[(x["start"], x["length"], x["period"]) for x in own or []] for own in batch.column("runs").to_pylist()]
            yield _rows([told(doc_id, words, own) for (doc_id, words), own in zip(_texts(iter([batch]), plant), runs, strict=True)])

    return read


def periodic_runs(docs: DataFrame, plant: Plant = as_is, lags: int = LAGS) -> DataFrame:
    """A row of RUNS for each row of docs. plant changes a text's words before they are searched."""
    rows = docs.select("doc_id", "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= 2 * PERIODS * lags  # so many words need so many bytes
    whole = rows.where(~long).mapInArrow(_whole(plant), RUNS)
    large = rows.where(long)
    units = large.mapInArrow(_units(plant, lags), UNITS).dropDuplicates(["digest", "low"])
    found = units.mapInArrow(_scanned, FOUND).groupBy("digest", "start", "length").agg(F.min("period").alias("period"))
    runs = stash(found.groupBy("digest").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")))  # fewer than the words of one text
    keyed = large.mapInArrow(_keyed(plant), "doc_id long, text string, digest string")
    dealt = keyed.join(runs, "digest", "left").select("doc_id", "text", "runs").mapInArrow(_joined(plant), RUNS)
    return whole.unionByName(dealt)


def op13_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(load(spark, sf_dir, "documents"), planted)
