"""Phrase collocation mining with suffix automata.

Texts are read by shard: the documents that a task has gathered when they reach SHARD_BYTES. A shard's phrases of bounded depth are
the states of its generalised suffix automaton: phrases that end at the same places (endpos) are one state, named by its longest
phrase, with the number of these places and the length of its shortest one; a suffix link leads to the longest suffix that ends at
more places. As the depth is bounded, the automaton is built level by level: a phrase of k words is the pair of the two phrases of
k - 1 words that it overlaps, and its suffix belongs to its state where both have equal counts. States are opened along their suffixes,
and leave a shard packed by language and bucket of phrases; buckets are summed over all shards, by the phrase itself, so counts are exact.

A frequent phrase has frequent words and frequent pairs only, so two passes before count words and pairs by 64-bit hashes, whose
counts are never below the true ones; sieves of both tell the automata where a phrase may lie. They lose no phrase.

Suffix links over all shards settle what is inside what: a phrase goes if the phrase with one more word, before or after it, is as
frequent (that with more words can't be so unless this one is). Scores are exact, in decimals of 38 digits.

A null text is empty, a null language is `und`. Empty texts, texts of separators and an empty table yield nothing. Repeated rows
count each, whatever their doc_id, null or not. Very long texts are whole; a shard holds one such text at least. Ties of the score
are settled by a, then the phrase, which is unique within its language. Columns other than lang and text are not read, of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import Sieve, _hash_block, as_bytes, blocks, discard, load, mix, shuffle_partitions, stash

#: Words of a phrase, occurrences of a candidate, phrases reported of each language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Bytes of text of a shard.
SHARD_BYTES = 6 << 20
#: Buckets of phrases for each shuffle partition: phrases of a bucket and language are summed in one group, so groups shrink as partitions are added.
BUCKETS = 4
#: Languages whose totals are sent to all tasks; more are joined by shuffle.
SENT_LANGS = 10_000

#: A-Z to lower case; what ends a piece is a line feed.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Shard:
    """Words of many texts in a row: their hashes (with the language), starts, and pieces."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.langs = sorted(set(langs))
        self.text = b"\n".join(texts).translate(LOWER)
        self.kind = np.int32 if len(self.text) < 1 << 31 else np.int64
        hashes, starts, pieces = [np.empty(0, np.uint64)], [np.empty(0, self.kind)], [np.empty(0, self.kind)]
        lines = 0
        for at, end in blocks(self.text):
            part = self.text[at:end]
            h, start = _hash_block(part)
            line = np.cumsum(np.frombuffer(part, np.uint8) == 10, dtype=np.int32)
            hashes.append(h)
            starts.append((start + at).astype(self.kind))
            pieces.append((line[start] + lines).astype(self.kind))
            lines += int(line[-1])
        self.start, self.piece = np.concatenate(starts), np.concatenate(pieces)
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.empty(0, np.int64)
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], self.kind)[np.searchsorted(first, self.start, "right") - 1]
        salts = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)
        self.hash = mix(np.concatenate(hashes) ^ salts[self.lang]) if len(self.start) else np.empty(0, np.uint64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word with the next one, and whether both lie in one piece."""
        return mix(self.hash[:-1] * PAIR + self.hash[1:]), self.piece[:-1] == self.piece[1:]

    def phrase(self, at: int, n: int) -> str:
        end = self.start[at + n] if at + n < len(self.start) else len(self.text)
        return b" ".join(self.text[self.start[at] : end].split()).decode()


def automaton(words: np.ndarray, follows: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The states of a shard's suffix automaton, of at most `depth` words: for each length of the longest phrase (length, where one
    lies, length of the shortest phrase, endpos count). words: hashes, 0 where none may lie; follows[i]: whether a phrase may go on from i to i + 1."""
    place = np.flatnonzero(words)
    key, low = words[place], None
    for k in range(1, depth + 1):
        _, first, own, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        first = place[first]
        ids = np.full(len(words) + 1, -1, np.int32 if len(words) < 1 << 31 else np.int64)
        ids[place] = own
        del own
        shortest = np.full(len(count), k)
        if low is not None:
            ids_before, first_before, count_before, shortest_before = low
            suffix = ids_before[first + 1]
            same = count_before[suffix] == count  # suffix and phrase end at the same places: one state
            shortest[same] = shortest_before[suffix[same]]
            inside = np.zeros(len(count_before), bool)
            inside[suffix[same]] = True
            yield k - 1, first_before[~inside], shortest_before[~inside], count_before[~inside]
        low = ids, first, count, shortest
        if k == depth or not len(place):
            yield k, first, shortest, count
            return
        place = place[(ids[place + 1] >= 0) & follows[place]]
        key = ids[place].astype(np.int64) * (len(count) + 1) + ids[place + 1]


def _sharded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """Of batches (lang, text)."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if text:
                langs.append(lang)
                texts.append(text)
                held += len(text) + 1
                if held >= size:
                    yield Shard(langs, texts)
                    langs, texts, held = [], [], 0
    if texts:
        yield Shard(langs, texts)


def _part(n: Column) -> Column:
    """The first n words of the phrase, or the last -n."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)


def _counted(lang: list, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h), pa.array(n)], names=["lang", "key", "n"])


def _words(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _sharded(batches, size):
            h, n = np.unique(shard.hash, return_counts=True)
            totals = np.bincount(shard.lang, minlength=len(shard.langs))
            yield _counted([None] * len(h), h.view(np.int64), n)
            yield _counted(shard.langs, np.zeros(len(totals), np.int64), totals)

    return read


def _pairs(size: int, words):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _sharded(batches, size):
            known = words.value.test(shard.hash)
            pairs, one_piece = shard.pairs()
            h, n = np.unique(pairs[one_piece & known[:-1] & known[1:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["key", "n"])

    return read


def _states(size: int, depth: int, buckets: int, words, pairs):
    """A row for each shard, language and bucket of phrases: the phrases of all states there, opened along their suffixes, and their counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _sharded(batches, size):
            own, one_piece = shard.pairs()
            follows = np.append(one_piece & pairs.value.test(own), False) if len(own) else np.zeros(len(shard.hash), bool)
            for k, at, shortest, count in automaton(np.where(words.value.test(shard.hash), shard.hash, np.uint64(0)), follows, depth):
                many = k - shortest + 1
                length = k - (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                at, count = np.repeat(at, many) + k - length, np.repeat(count, many)
                phrases = [shard.phrase(i, n) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(p) % buckets for p in phrases), np.int64, len(phrases))
                order = np.lexsort((bucket, shard.lang[at]))
                lang, bucket = shard.lang[at][order], bucket[order]
                first = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1]))[: len(order)])
                ends = pa.array(np.append(first, len(order)).astype(np.int32))
                sorted_ = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x, kind))  # noqa: B023, E731
                columns = [pa.array([shard.langs[i] for i in lang[first].tolist()], pa.string()), pa.array(bucket[first].astype(np.int32)), sorted_([phrases[i] for i in order.tolist()], pa.string()), sorted_(count[order].astype(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "phrases", "counts"])

    return read


def _summed(least: int):
    """Of all rows of a language and bucket: the phrases that occur often enough over all shards."""

    def add(table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten()
        sums = pa.table({"phrase": flat("phrases"), "n": flat("counts")}).group_by("phrase").aggregate([("n", "sum")])
        often = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
        phrases = often.column("phrase")
        spaces = pc.count_substring(phrases, " ")
        lang = pa.array([table.column("lang")[0].as_py()] * len(often), pa.string())
        return pa.table([lang, phrases, pc.add(spaces, 1).cast(pa.int32()), often.column("n_sum").cast(pa.int64())], names=["lang", "phrase", "k", "f"])

    return add


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, size: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k (words), f: all phrases of up to `depth` words that occur so often; and lang, n: all words. Both are tables."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    counted = stash(texts.mapInArrow(_words(size), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("lang").isNotNull()))
    totals = stash(counted.where("lang is not null").select("lang", "n"))
    words = spark.sparkContext.broadcast(Sieve(counted.where("lang is null").select("key")))
    found = stash(texts.mapInArrow(_pairs(size, words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
    pairs = spark.sparkContext.broadcast(Sieve(found))
    buckets = BUCKETS * shuffle_partitions(spark)
    states = texts.mapInArrow(_states(size, depth, buckets, words, pairs), "lang string, bucket int, phrases array<string>, counts array<long>")
    phrases = stash(states.groupBy("lang", "bucket").applyInArrow(_summed(least), "lang string, phrase string, k int, f long"))
    discard(counted, found)
    words.destroy()
    pairs.destroy()
    return phrases, totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that lie in no longer one as frequent."""
    candidates = phrases.where("k > 1")
    sub = [candidates.where("k > 2").select("lang", _part(x).alias("phrase"), F.col("f").alias("outer")) for x in (F.col("k") - 1, 1 - F.col("k"))]
    outer = sub[0].unionByName(sub[1]).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = candidates.join(outer, ["lang", "phrase"], "left").where("outer is null or outer < f")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", _part(F.col("cut")).alias("first"), _part(F.col("cut") - F.col("k")).alias("rest"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    few = totals.count() <= SENT_LANGS
    met = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals) if few else totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    best = met.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language, with rank. All rows are sorted into ranges, and ranks go on from range to range, so that no task holds a language."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    placed = stash(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    parts = placed.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = parts.alias("x").join(parts.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("y.part") < F.col("x.part")), "left")
    starts = before.groupBy(F.col("x.lang").alias("lang"), F.col("x.part").alias("part"), F.col("x.first").alias("first")).agg(F.coalesce(F.sum("y.rows"), F.lit(0)).alias("before")).where(F.col("before") < top)
    rank = F.col("before") + F.col("at") - F.col("first") + 1
    return placed.join(starts, ["lang", "part"]).withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, size: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, depth, least, size)
    return ranked(scored(phrases, totals), top)


def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?' || chr(10) || '-' || chr(13) || ']')) AS piece FROM docs),
pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[ ' || chr(9) || ']+'), lambda x: x <> '') AS w FROM cut),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS found FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
phrases AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(found) AS phrase FROM grams) GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM phrases),
inner_ AS (SELECT DISTINCT s.lang, s.phrase FROM split s JOIN split o ON o.lang = s.lang AND o.k > s.k AND o.f >= s.f AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')),
cuts AS (SELECT s.lang, s.phrase, s.f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM split s, (SELECT unnest(range(1, 5)) AS c) WHERE s.k > 1 AND c < s.k AND (s.lang, s.phrase) NOT IN (SELECT (lang, phrase) FROM inner_)),
met AS (SELECT c.lang, c.phrase, c.a, p.f AS l, q.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (p.f::HUGEINT * q.f) AS score, c.c FROM cuts c JOIN phrases p ON p.lang = c.lang AND p.phrase = c.x JOIN phrases q ON q.lang = c.lang AND q.phrase = c.y JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best QUALIFY rank <= 2000
"""
