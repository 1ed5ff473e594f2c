"""Sharding by balanced label propagation.

Documents are linked with those of equal texts, and with those of near texts: of 32 min-hashes of their five-word shingles at least
22 agree, met by one of eight bands of four. Pairs as similar as 0.8 agree in 22 with a chance of 0.96 and meet with one of 0.98;
links of pairs somewhat less alike do no harm. In a band's bucket all link with one of them, so links grow with the documents. Documents of one text are one cluster with the number of its members as weight, and move together; a text of
more documents than a shard holds is first dealt by hash into clusters that fit one, and near texts link with the first of these.

A label is a shard. Clusters of several documents take the first label that most members drew by hash; shards admit them, largest
first, until their quota is full. Then labels spread: in each round a cluster counts the labels that its neighbours hold by then,
and asks for the shard that holds more of them than its own does and has room for it; shards again admit the largest first. Half
of the clusters, drawn anew each round, may ask, so that neighbours don't just swap. Rounds go on until no cluster asks, or none is
admitted twice, or the cut hasn't fallen below its lowest for three rounds; the labels of the lowest cut hold. Documents without a link, and members of clusters that found no room as a whole, fill what is left of the quotas.
The law is `rows`: shard counts are at most one apart.

A null text has no bytes and no link; empty texts are equal to each other. Repeated rows, and rows without an id, are members of
one group each by their text. Very long texts are read whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import as_bytes, discard, hash_texts, load, mix, stash, windows
from loamgrid.llm.ranks import numbered

SHARDS = 40
#: Rounds of moves after which a cut that hasn't fallen is settled.
PATIENCE = 3
#: Share of a quota that a cluster cut from a larger group fills on average.
FILL = 0.9
#: Parts that the requests to one shard are dealt into by rank of size, to admit them without one task for a shard.
STEPS = 64
#: Words of a shingle, bands of a sketch, min-hashes of a band, and how many of all must agree.
WORDS, BANDS, DEPTH, AGREE = 5, 8, 4, 22
#: Shingles that are hashed at once.
CHUNK = 4096

KEY = ["h", "text_crc32", "size"]


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the key of the text (h, text_crc32, size; h null for a null text)."""
    return docs.select("doc_id", *_of_text())


def _of_text() -> list[Column]:
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    return [size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.when(text.isNotNull(), F.xxhash64(text)).alias("h")]


def _cluster(part: Column) -> Column:
    return F.xxhash64(*KEY, part.cast("long"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (cluster, text): cluster, its min-hashes and bands, a cluster once for each task; none for texts without words."""
    turns = mix(np.arange(1, BANDS * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
    mixed = mix(np.arange(1, DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
    seen: set[int] = set()
    for batch in batches:
        clusters, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        new = {k: t for k, t in zip(clusters, texts, strict=True) if k not in seen}
        seen.update(new)
        keys, sketches = [], []
        for key, words in zip(new, hash_texts(list(new.values())), strict=True):
            shingles = windows(words, WORDS)
            if len(shingles):
                parts = (shingles[i : i + CHUNK, None] * turns for i in range(0, len(shingles), CHUNK))
                keys.append(key)
                sketches.append(reduce(np.minimum, (p.min(axis=0) for p in parts)))
        table = np.array(sketches, np.uint64).reshape(-1, BANDS * DEPTH)
        bands = mix((table.reshape(-1, BANDS, DEPTH) * mixed).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        lists = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind))
        low = (table >> np.uint64(32)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(low, pa.int32()), lists(bands.view(np.int64), pa.int64())], names=["cluster", "sketch", "bands"])


def near_links(docs: DataFrame) -> DataFrame:
    """a, b: clusters of near texts, each pair once, as a table. A bucket's clusters meet its smallest one only."""
    texts = docs.where("text is not null").select("text", *_of_text()).select(_cluster(F.lit(0)).alias("cluster"), "text")
    sketches = stash(texts.mapInArrow(_sketched, "cluster long, sketch array<int>, bands array<long>").dropDuplicates(["cluster"]))
    dealt = sketches.select("cluster", F.explode("bands").alias("band"))
    buckets = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("cluster").alias("first")).where("n > 1").drop("n")
    met = dealt.join(buckets, "band").where("cluster <> first").select("cluster", "first").distinct()
    of = lambda c: sketches.select(F.col("cluster").alias(c), F.col("sketch").alias(f"of_{c}"))
    alike = F.size(F.filter(F.zip_with("of_cluster", "of_first", lambda x, y: x == y), lambda x: x))
    links = met.join(of("cluster"), "cluster").join(of("first"), "first").where(alike >= AGREE)
    found = stash(links.select(F.greatest("cluster", "first").alias("a"), F.least("cluster", "first").alias("b")).distinct())
    discard(sketches)
    return found


def _free(spark: SparkSession, quotas: list[int], used: list[int]) -> DataFrame:
    """shard, room: of the shards that are not full, one row each."""
    rooms = [(i, q - u) for i, (q, u) in enumerate(zip(quotas, used, strict=True)) if q > u]
    return F.broadcast(spark.createDataFrame(rooms, "shard int, room long"))


def admit(asks: DataFrame, free: DataFrame) -> DataFrame:
    """asks: cluster, n, shard. Those that the shards let in, largest first: sizes are summed by (shard, size step), and only steps
    that fit as a whole, or members within one, are let in."""
    sized = asks.withColumn("step", F.struct((-F.col("n")).alias("size"), F.pmod(F.xxhash64("cluster"), F.lit(STEPS)).alias("part")))
    steps = sized.groupBy("shard", "step").agg(F.sum("n").alias("load"))
    ahead = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.select("shard", "step", F.coalesce(F.sum("load").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "step").orderBy("cluster")
    placed = sized.withColumn("own", F.sum("n").over(within)).join(before, ["shard", "step"]).join(free, "shard")
    return placed.where(F.col("before") + F.col("own") <= F.col("room"))


def _loads(rows: DataFrame, shard: str) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(shard).agg(F.sum("n")).collect()}  # one row for each shard


def place(held: DataFrame, quotas: list[int]) -> DataFrame:
    """held: cluster, n, shard, held (how many of its n members drew that label). Returns cluster, n, shard of the admitted, a table.
    A cluster asks as long as a shard has room for it, and a shard that is asked lets the largest in, so every round but the last
    admits some; those that fit nowhere are left."""
    spark = held.sparkSession
    admitted = spark.createDataFrame([], "cluster long, n long, shard int")
    used, waiting, tables = [0] * len(quotas), held, []
    for k in count():
        rooms = [(i, q - u) for i, (q, u) in enumerate(zip(quotas, used, strict=True)) if q > u]
        if not rooms:
            break
        free = _free(spark, quotas, used)
        # a cluster whose members' shards are all full asks for one of the others with room for it, by hash
        fitting = F.filter(F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(r).cast("long").alias("room")) for i, r in rooms]), lambda x: x["room"] >= F.col("n"))
        anywhere = F.try_element_at(fitting, (F.pmod(F.xxhash64("cluster", F.lit(k)), F.greatest(F.size(fitting), F.lit(1))) + 1).cast("int"))["shard"]
        # what most members drew, among the shards with room for all; the hash settles ties
        asks = (
            waiting.join(free, "shard", "left")
            .groupBy("cluster", "n")
            .agg(F.max_by("shard", F.when(F.col("n") <= F.col("room"), F.struct("held", F.xxhash64("cluster", "shard")))).alias("shard"))
            .withColumn("shard", F.coalesce("shard", anywhere))
            .where("shard is not null")
        )
        new = stash(admit(asks, free).select("cluster", "n", "shard"))
        got = _loads(new, "shard")
        if not got:
            break
        used = [u + got.get(i, 0) for i, u in enumerate(used)]
        admitted = admitted.unionByName(new)
        before, waiting = waiting, stash(waiting.join(new.select("cluster"), "cluster", "left_anti"))
        tables += [new, before] if k else [new]
        if not waiting.head(1):
            break
    whole = stash(admitted)
    discard(*tables)
    return whole


def spread(labels: DataFrame, links: DataFrame, quotas: list[int], patience: int = PATIENCE) -> tuple[DataFrame, list[int]]:
    """labels: cluster, n, shard, a table; links: a, b. The labels after the moves, a table, and the cut before each round and after
    the last: pairs of documents that links join and labels part. The labels of the lowest cut are returned."""
    spark = labels.sparkSession
    both = links.select(F.col("a").alias("cluster"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cluster"), F.col("a").alias("other")))
    cuts: list[int] = []
    best, lowest, idle = labels, 0, 0  # lowest: the place of the lowest cut
    for k in count():
        used = _loads(labels, "shard")
        free = _free(spark, quotas, [used.get(i, 0) for i in range(len(quotas))])
        theirs = labels.select(F.col("cluster").alias("other"), F.col("shard").alias("to"), F.col("n").alias("weight"))
        votes = both.join(theirs, "other").groupBy("cluster", "to").agg(F.sum("weight").alias("votes"))
        open_ = (F.col("to") != F.col("shard")) & (F.col("room") >= F.col("n"))
        counted = votes.join(labels, "cluster").join(free.withColumnRenamed("shard", "to"), "to", "left").groupBy("cluster", "n", "shard").agg(
            F.max(F.when(open_, F.struct("votes", F.xxhash64("cluster", "to").alias("tie"), "to"))).alias("best"),
            F.coalesce(F.sum(F.when(F.col("to") == F.col("shard"), F.col("votes"))), F.lit(0)).alias("own"),
            F.sum("votes").alias("all"),
        )
        table = stash(counted)
        cuts.append((table.agg(F.sum(F.col("n") * (F.col("all") - F.col("own")))).first()[0] or 0) // 2)
        if cuts[k] < cuts[lowest]:
            before, best, lowest = best, labels, k
            discard(before)
        asks = table.where(F.col("best.votes") > F.col("own"))
        if k - lowest >= patience or idle == 2 or not asks.head(1):
            discard(table, *([labels] if labels is not best else []))
            return best, cuts
        turn = F.pmod(F.xxhash64("cluster", F.lit(k)), F.lit(2)) == 0
        new = stash(admit(asks.where(turn).select("cluster", "n", F.col("best.to").alias("shard")), free).select("cluster", F.col("shard").alias("to")))
        idle = 0 if new.head(1) else idle + 1
        before, labels = labels, stash(labels.join(new, "cluster", "left").select("cluster", "n", F.coalesce("to", "shard").alias("shard")))
        discard(table, new, *([before] if before is not best else []))
    raise AssertionError("rounds end above")


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    return shards_and_cuts(docs, n_shards)[0]


def shards_and_cuts(docs: DataFrame, n_shards: int = SHARDS) -> tuple[DataFrame, list[int]]:
    """The shard of each document, and the cut before each round of moves and after the last."""
    spark = docs.sparkSession
    known = linked(docs)
    links = near_links(docs)
    ends = links.select(F.col("a").alias("near")).unionByName(links.select(F.col("b").alias("near"))).distinct()
    texts = known.where("h is not null").groupBy(*KEY).agg(F.count("*").alias("members")).withColumn("near", _cluster(F.lit(0)))
    groups = stash(texts.join(ends.withColumn("met", F.lit(True)), "near", "left").where("members > 1 or met").select(*KEY, "members"))
    total = known.count()
    quotas = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    fits = max(1, int(FILL * (total // n_shards)))
    part = F.when(F.col("members") > quotas[-1], F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / fits))).otherwise(0)
    rows = stash(known.join(groups, KEY, "left").select("doc_id", "size", "text_crc32", F.when(F.col("members").isNotNull(), _cluster(part)).alias("cluster")))
    label = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")  # the first label of each document
    by_label = rows.where("cluster is not null").groupBy("cluster", label.alias("shard")).agg(F.count("*").alias("held"))
    sizes = by_label.groupBy("cluster").agg(F.sum("held").alias("n"))
    held = stash(by_label.join(sizes, "cluster").select("cluster", "n", "shard", "held"))
    labels, cuts = spread(place(held, quotas), links, quotas)
    discard(held, groups, links)
    placed = rows.where("cluster is not null").join(labels.select("cluster", "shard"), "cluster", "left")
    taken = _loads(labels, "shard")
    room, at = [], 0
    for i, quota in enumerate(quotas):
        room.append((i, at, at + quota - taken.get(i, 0)))
        at = room[-1][2]
    ranges = F.broadcast(spark.createDataFrame(room, "shard int, first long, end long").where("first < end"))
    alone = ["doc_id", "size", "text_crc32"]
    left = rows.where("cluster is null").select(alone).unionByName(placed.where("shard is null").select(alone))
    rest = numbered(left.withColumn("one", F.lit(0)), ["one"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "number")
    filled = rest.join(ranges, (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    whole = stash(placed.where("shard is not null").select(columns).unionByName(filled.select(columns)))
    slots = numbered(whole, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), cuts


def op10_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(load(spark, sf_dir, "documents"))
