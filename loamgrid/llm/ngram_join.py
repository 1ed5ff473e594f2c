"""N-gram Jaccard join by vertical partitioning, exact.

Documents with equal words are one class, and classes are compared. The global order of n-grams is by hash, with the frequent
ones last, rarest first; two sets as similar as asked for share an n-gram in the first few of both (their prefixes). The order
is cut into fragments: prefixes propose pairs, then the overlap of a pair is counted in each fragment apart and summed.

Only components are asked for, so pairs are proposed in rounds, and those whose classes are in one component by then are left
out. An n-gram of two classes proposes this pair. Of the others' classes, a few for each n-gram (HUBS of them, drawn by hash and by
the number of its classes) are hubs of the first round, GROWTH times as many of the second, and so on up to all; a pair is proposed
in the round in which one of its classes is a hub and neither was before. So every pair has its turn, and the first round proposes
HUBS pairs for each class and n-gram, however large a group of near copies is. Later rounds have the n-grams of several components
only, and pair those of the largest one with the others, never with each other: what they cost grows with what is still apart.
Proposals must have sizes, places of their first common n-gram, and parity bitmaps (whose differing bits never exceed the number
of differing n-grams) that leave the similarity possible. No link is lost. After each round, new links contract the components.

Texts are read where they lie and never shuffled; what they yield is told apart by the key of their words, and a sieve of
bounded size (and an exact join after it) picks the classes that are asked for.

Null texts and texts without words have no n-grams and link with nothing; fewer words than n are one n-gram. Rows with a null
doc_id link with nothing and have a null component. Repeated rows are linked as equal; rows of one id and different words are
rows of their own. Very long texts are whole sets like others. Columns other than doc_id and text are not read, of any name;
keep_one_of_each hands them on. Classes are keyed by 64-bit hashes of their words, n-grams by 64-bit hashes. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import Sieve, as_bytes, discard, distinct, hash_texts, load, stash, stash_observed, windows
from loamgrid.llm.components import components

WORDS, PERCENT = 3, 90
#: An n-gram counts as frequent with more documents than this; the list of the most frequent holds so many at most. Both
#: settle the order alone, which changes costs and no result.
FREQUENT, LISTED = 8, 500_000
#: Fragments of the global order.
FRAGMENTS = 8
#: Bits of a parity bitmap, in 64-bit words: of a whole set, and of each fragment of a set of more than LARGE n-grams.
BITMAP, FRAGMENT_BITMAP, LARGE = 12, 32, 1_200
#: Hubs of an n-gram in the first round, on average, and how many times more each further round has.
HUBS, GROWTH = 4, 1_024
#: Parts of sets in one file.
PART_ROWS = 20_000
#: Classes of an n-gram that meet its hubs in one part of a join.
SALTED = 4_096

KEYS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType())])
PROFILES = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(f"b{i}", T.LongType()) for i in range(BITMAP)], T.StructField("tokens", T.ArrayType(T.LongType()))])
PARTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("fragment", T.IntegerType()), T.StructField("part", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
TOKENS = T.StructType([T.StructField("token", T.LongType()), T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType())])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def key_of(text: bytes | None) -> int | None:
    words = (text or b"").lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([key_of(t) for t in as_bytes(batch.column(1))], pa.int64())], names=KEYS.names)


def _sets(batches: Iterator[pa.RecordBatch], words: int, sieve=None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Of batches (text): keys and sorted sets, a key once for each task, of those that the sieve finds."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, len(batch), 1000):
            texts = as_bytes(batch.slice(at, 1000).column(0))
            keys = [key_of(t) for t in texts]
            if sieve is not None:
                found = sieve.value.test(np.array([k or 0 for k in keys], np.int64)).tolist()
                keys = [k if f else None for k, f in zip(keys, found, strict=True)]
            rows: dict[int, bytes] = {k: t for k, t in zip(keys, texts, strict=True) if k is not None and k not in seen}
            seen.update(rows)
            yield list(rows), [distinct(windows(h, words)) for h in hash_texts(list(rows.values()))]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def parity(own: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of so many 64-bit words: each n-gram turns one bit."""
    odd = np.bincount((own % np.uint64(64 * size)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counted(words: int, percent: int):
    """The n-grams of one and a half prefixes by hash: those that the order may put first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, words):
            found = [s[: prefix_size(len(s), percent) * 3 // 2 + 8] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["token"])

    return read


def _profiled(words: int, percent: int, frequent):
    def prefix(own: np.ndarray, listed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        size = prefix_size(len(own), percent)
        if not len(listed):
            return own[:size]
        for part in (own[: 2 * size + 8], own):
            at = np.minimum(np.searchsorted(listed, part), len(listed) - 1)
            known = listed[at] == part
            first = part[~known][:size]
            if len(first) == size:
                return first
        rest = own[known]
        return np.concatenate([first, rest[np.lexsort((rest, counts[at[known]]))][: size - len(first)]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = frequent.value
        for keys, sets in _sets(batches, words):
            bits = np.zeros((len(sets), BITMAP), np.int64)
            for i, s in enumerate(sets):
                bits[i] = parity(s, BITMAP)
            columns = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(bits[:, i].copy()) for i in range(BITMAP)), _lists([prefix(s, listed, counts) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=PROFILES.names)

    return read


def _of_tokens(sieve):
    """Rows of TOKENS from (key, tokens): of the n-grams that the sieve finds, with their places."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.arange(len(tokens)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            hit = sieve.value.test(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hit]), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)[hit]), pa.array(at[hit].astype(np.int32))], names=TOKENS.names)

    return read


def _parted(words: int, fragments: int, sieve):
    edges = np.array([((1 << 64) * i // fragments) for i in range(1, fragments)], np.uint64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _sets(batches, words, sieve):
            cut = [p for s in sets for p in np.split(s, np.searchsorted(s, edges))]
            large = np.repeat([len(s) > LARGE for s in sets], fragments).tolist()
            bits = [parity(p, FRAGMENT_BITMAP).view(np.uint64) if x else p[:0] for p, x in zip(cut, large, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), fragments)), pa.array(np.tile(np.arange(fragments, dtype=np.int32), len(keys))), _lists(cut), _lists(bits)], names=PARTS.names)

    return read


def _differing(a: str, b: str) -> Column:
    total = F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0")))
    for i in range(1, BITMAP):
        total += F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}")))
    return total


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps leave the similarity possible: |A|+|B| - differing >= 2 * overlap, as large as it must be."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * (n + m - _differing(a, b)) >= 2 * percent * (n + m))


class Join:
    """The stages of one join; tables live in the shared folder until their last reader is done."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.words, self.percent, self.spark = words, percent, docs.sparkSession
        self.known = docs.where("doc_id is not null").select("doc_id", "text")
        self.unknown = docs.where("doc_id is null").select("text")
        self.ids = stash(self.known.mapInArrow(_keyed, KEYS))
        self.proposed: list[int] = []  # pairs of each round
        self.kept: list[DataFrame] = []  # tables that the result reads

    def profiles(self) -> DataFrame:
        """One row for each class."""
        texts = self.known.select("text")
        counts = texts.mapInArrow(_counted(self.words, self.percent), "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT)
        top = counts.orderBy(F.desc("n"), "token").limit(LISTED).toArrow()
        listed, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
        order = np.argsort(listed)
        frequent = self.spark.sparkContext.broadcast((listed[order], n[order]))
        return stash(texts.mapInArrow(_profiled(self.words, self.percent, frequent), PROFILES).dropDuplicates(["key"]))

    def links(self, pairs: DataFrame, n: int, n_large: int) -> DataFrame:
        """pairs: a, b (keys), na, nb (sizes), a table of n rows, n_large of them of two large sets. A table of those (a, b) that are as similar as asked for."""
        asked = stash(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), 2 * n)
        sieve = self.spark.sparkContext.broadcast(Sieve(asked))
        parts = self.known.select("text").mapInArrow(_parted(self.words, FRAGMENTS, sieve), PARTS).join(asked, "key", "left_semi").dropDuplicates(["key", "fragment"])
        parts = stash(parts, 2 * n * FRAGMENTS, PART_ROWS)
        discard(asked)

        def by_fragment(some: DataFrame, column: str, count: Column) -> DataFrame:
            """The pairs with the sum of what is counted in each fragment apart."""
            each = some.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
            side = lambda c: parts.select(F.col("key").alias(c), "fragment", F.col(column).alias(f"of_{c}"))
            met = each.join(side("a"), ["a", "fragment"]).join(side("b"), ["b", "fragment"])
            return met.select("a", "b", "na", "nb", count.alias("counted")).groupBy("a", "b", "na", "nb").agg(F.sum("counted").alias("counted"))

        both = F.col("na") + F.col("nb")
        left = pairs
        if n_large:
            large = F.least("na", "nb") > LARGE
            differing = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
            possible = by_fragment(pairs.where(large), "bits", differing).where((100 + self.percent) * (both - F.col("counted")) >= 2 * self.percent * both)
            left = stash(pairs.where(~large).unionByName(possible.select(pairs.columns)), n)
        overlap = by_fragment(left, "part", F.size(F.array_intersect("of_a", "of_b")))
        found = stash(overlap.where((100 + self.percent) * F.col("counted") >= self.percent * both).select("a", "b"), n)
        discard(parts, *([left] if n_large else []))
        sieve.destroy()
        return found

    def _near(self, pairs: DataFrame, shape: DataFrame) -> DataFrame:
        met = pairs.join(shape.alias("p"), F.col("a") == F.col("p.key")).join(shape.alias("q"), F.col("b") == F.col("q.key"))
        return met.where(_possible("p", "q", self.percent)).select("a", "b", F.col("p.n").alias("na"), F.col("q.n").alias("nb"))

    def across(self, rows: DataFrame, turn: int) -> DataFrame:
        """The pairs of one round. rows: token, key, at, component, level (none below turn), salts, major, n and the bitmap, of n-grams of several components."""
        n, m = F.col("p.n"), F.col("q.n")
        once = (F.col("q.level") > turn) | (F.col("p.key") < F.col("q.key"))
        placed = (100 + self.percent) * F.least(n - F.col("p.at"), m - F.col("q.at")) >= self.percent * (n + m)
        on = (F.col("p.token") == F.col("q.token")) & (F.col("p.salt") == F.col("q.salt")) & (F.col("p.component") != F.col("q.component")) & once & placed & _possible("p", "q", self.percent)
        hubs = rows.where(F.col("level") == turn).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
        found = None
        for p, q in ((hubs.where(~F.col("major")), dealt), (hubs.where("major"), dealt.where(~F.col("major")))):
            met = p.alias("p").join(q.alias("q"), on).select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b"), F.when(F.col("p.key") < F.col("q.key"), n).otherwise(m).alias("na"), F.when(F.col("p.key") < F.col("q.key"), m).otherwise(n).alias("nb"))
            found = met if found is None else found.unionByName(met)
        return found.distinct()

    def mixed(self, rows: DataFrame, n: int | None, found: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """rows (n of them, if known) of this round, a table, and their number: those of n-grams of several components by now, and whether they lie in the n-gram's largest one."""
        placed = rows.where(F.col("level") >= turn).drop("component", "major").join(found, F.col("key") == F.col("id"), "left").withColumn("component", F.coalesce("component", "key")).drop("id")
        sizes = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
        several = sizes.groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("size", "component"))["component"].alias("largest")).where("k > 1").select("token", "largest")
        table, seen = stash_observed(placed.join(several, "token").withColumn("major", F.col("component") == F.col("largest")).drop("largest"), F.count(F.lit(1)).alias("n"), rows=n)
        return table, seen["n"]

    def run(self) -> DataFrame:
        """doc_id, key, n_shingles, component_id for each row with an id."""
        profiles = self.profiles()
        shape = profiles.select("key", "n", *[f"b{i}" for i in range(BITMAP)])
        tokens = profiles.select("key", F.explode("tokens").alias("token"))
        met = stash(tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("key").alias("a"), F.max("key").alias("b")).where("c > 1"))
        several = met.where("c > 2").select("token", "c")
        sieve = self.spark.sparkContext.broadcast(Sieve(several.select("token")))
        rank = F.col("c") * (F.xxhash64("key").cast("double") / 2.0**64 + 0.5)  # about its place among the n-gram's classes, by hash
        level = F.when(rank < HUBS, 0).otherwise(F.floor(F.log(rank / HUBS) / float(np.log(GROWTH))) + 1).cast("int")
        shared = profiles.select("key", "tokens").mapInArrow(_of_tokens(sieve), TOKENS).join(several, "token")
        shared = shared.withColumn("level", level).withColumn("salts", F.ceil(F.col("c") / SALTED).cast("int")).drop("c")
        rows = stash(shared.join(shape, "key").withColumn("component", F.col("key")).withColumn("major", F.lit(False)))
        first = self._near(met.where("c = 2").select("a", "b").distinct(), shape).unionByName(self.across(rows, 0)).distinct()
        found, turn, n_found, n_rows = None, 0, 0, None
        while True:
            large = F.coalesce(F.sum((F.least("na", "nb") > LARGE).cast("long")), F.lit(0))
            pairs, seen = stash_observed(first if not turn else self.across(rows, turn), F.count(F.lit(1)).alias("n"), large.alias("large"))
            self.proposed.append(seen["n"])
            if seen["n"] or found is None:
                new = self.links(pairs, seen["n"], seen["large"])
                n_found += 2 * seen["n"]
                before, found = found, merged(found, new, seen["n"], n_found)
                discard(new, *([before] if before else []))
            discard(pairs)
            turn += 1
            before, (rows, n_rows) = rows, self.mixed(rows, n_rows, found, turn)
            discard(before)
            if not n_rows:
                break
        sieve.destroy()
        sizes = stash(profiles.select("key", "n"))
        discard(rows, met, profiles)
        classes = self.ids.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        owner = stash(classes.join(found, F.col("key") == F.col("id"), "left").join(sizes, "key").select("key", "n", "doc_id", F.coalesce("component", "key").alias("component")))
        smallest = owner.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of_key = stash(owner.join(smallest, "component").select("key", "component_id", "n"))
        discard(found, sizes, owner)
        self.kept = [self.ids, of_key]
        return self.ids.join(of_key, "key", "left").select("doc_id", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

    def without_id(self) -> DataFrame:
        """n_shingles of the rows without an id."""
        words = self.words

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [len(distinct(windows(h, words))) for h in hash_texts([t or b"" for t in as_bytes(batch.column(0))])]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_shingles"])

        return self.unknown.mapInArrow(sizes, "n_shingles long")


def merged(found: DataFrame | None, links: DataFrame, n: int, size: int) -> DataFrame:
    """found: id, component so far; links: a, b, n at most. The components with the new links, a table of `size` rows at most: only
    links between components are contracted."""
    if found is None:
        return stash(components(links, n), size)
    of = lambda c: found.select(F.col("id").alias(f"id_{c}"), F.col("component").alias(f"of_{c}"))
    lifted = links.join(of("a"), F.col("a") == F.col("id_a"), "left").join(of("b"), F.col("b") == F.col("id_b"), "left")
    new = stash(components(lifted.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), n), 2 * n)
    up = new.select(F.col("id").alias("low"), F.col("component").alias("up"))
    moved = found.join(up, F.col("component") == F.col("low"), "left").select("id", F.coalesce("up", "component").alias("component"))
    whole = stash(moved.unionByName(new.join(found, "id", "left_anti")), size)
    discard(new)
    return whole


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    join = Join(docs, words, percent)
    nulls = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "component_id")]
    columns = ["doc_id", "n_shingles", "component_id"]
    return join.run().select(columns).unionByName(join.without_id().select(nulls[0], "n_shingles", nulls[1]))


def _sifted(sieve, wanted: bool, keyed: bool = False):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            hit = sieve.value.test(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(hit == wanted))
            if keyed:
                part = pa.RecordBatch.from_arrays([*part.columns, pa.array([key_of(t) for t in as_bytes(part.column("text"))], pa.int64())], names=[*part.schema.names, "__key"])
            yield part

    return read


def keep_one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of docs, all columns: of each component one row of the document with the smallest id. Rows that link with nothing stay.
    A sieve tells the rows that may go from those that surely stay, so that only the former are shuffled."""
    spark, names = docs.sparkSession, docs.columns
    join = Join(docs, words, percent)
    all_rows = stash(join.run())
    discard(*join.kept)
    gone = stash(all_rows.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone")).distinct())
    again = all_rows.where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    sieve = spark.sparkContext.broadcast(Sieve(gone.select(F.col("__id").alias("doc_id")).unionByName(again)))
    discard(all_rows)
    stay = docs.mapInArrow(_sifted(sieve, False), docs.schema)
    maybe = docs.mapInArrow(_sifted(sieve, True, True), T.StructType([*docs.schema.fields, T.StructField("__key", T.LongType())]))
    left = maybe.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__gone")), "left_anti")
    wordless = F.col("__key").isNull()
    return stay.unionByName(left.where(wordless).select(names)).unionByName(left.where(~wordless).dropDuplicates(["doc_id", "__key"]).select(names))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))
