"""Line dedup by a log-template tree.

A line's leaf is its number of tokens and its leading tokens, where a token with a digit is a variable field. Within a leaf a
token is constant at its place if enough lines have it there; other places are variable fields. Lines of a leaf with the
same constants have one template, if enough of their tokens are constant. A template that at least `min_docs` documents have is
a candidate. It recurs if these documents have at least `min_docs` different surroundings, and then its lines are dropped.

A document's surrounding is the smallest hash of its own lines: those without a candidate template and without a sketched run of
tokens that `min_docs` documents hold. So neither copies of whole documents, slightly changed ones among them, nor lines that
stand together with the template decide, whatever share of the rows they are. For a document without own lines it is the smallest
recurring hash of its other lines. Copies with wholly rewritten lines count as different.

A null text stays null and an empty one empty; documents stay, even if all their lines go. Blank lines are kept and have no
template. Lines and texts of any length are read whole. Each row counts as a document, by its id; repeated rows with one id count
once. Null ids count as one document. Ties of hashes don't matter, as only smallest ones are compared. No rows give no rows. Further
columns of any name are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import STEP, Sieve, as_bytes, discard, load, masked_words, mix, stash, windows

DEPTH, MIN_DOCS, SIMILARITY = 3, 10, 0.5
#: Tokens of a run, and runs (the smallest hashes) of a line's sketch.
RUN, SKETCH = 5, 4
#: Rows of a table up to which it is sent to all tasks instead of shuffled to.
SENT_ROWS = 1_000_000
#: Hashes of recurring lines (8 bytes each) that are sent to all tasks at once.
BLOCK = 1_000_000

#: The hash of a variable field.
FIELD = np.uint64(1)

LINES = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "leaf", "line")), T.StructField("tokens", T.ArrayType(T.LongType()))])
#: leaf is null but for the first line of a leaf in a document.
SKETCHES = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "leaf", "line")), T.StructField("runs", T.ArrayType(T.LongType()))])


class Lines:
    """The lines with tokens of some texts, one after the other: doc (place of the text), nth (its line number there), line and leaf
    (hashes), tokens (all hashes, variable fields alike) and size (tokens of each line)."""

    def __init__(self, texts: list[bytes], depth: int = DEPTH):
        joined = b"\n".join(texts)
        self.tokens, start = masked_words(joined, FIELD)
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        at = np.searchsorted(breaks, start)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        self.size = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, self.size)
        weight = mix(np.arange(1, self.size.max(initial=0) + 1, dtype=np.uint64) * STEP) | np.uint64(1)
        part = self.tokens * weight[place]
        total = lambda x: np.add.reduceat(x, first) if len(first) else x
        size = self.size.astype(np.uint64)
        self.line = (mix(total(part) + size) >> np.uint64(1)).view(np.int64)
        self.leaf = (mix(total(np.where(place < depth, part, np.uint64(0))) + size * STEP) >> np.uint64(1)).view(np.int64)
        opens = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.doc = np.searchsorted(opens, start[first], side="right") - 1
        self.nth = at[first] - np.searchsorted(breaks, opens)[self.doc]

    def keep(self, kept: np.ndarray) -> None:
        """Only the lines with a true value stay."""
        self.tokens = self.tokens[np.repeat(kept, self.size)]
        self.doc, self.nth, self.line, self.leaf, self.size = (x[kept] for x in (self.doc, self.nth, self.line, self.leaf, self.size))


def first_of(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a value is the first such of its document."""
    order = np.lexsort((value, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1]))[: len(order)]
    found = np.zeros(len(order), bool)
    found[order[new]] = True
    return found


def sketches_of(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hashes of runs of each line, one line after the other, and where each line's end; a line shorter than a run has its own hash."""
    sizes = lines.size
    place = np.flatnonzero(sizes < RUN)
    runs = lines.line[place].view(np.uint64)
    if sizes.sum() >= RUN:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        within = owner[RUN - 1 :] == owner[: len(owner) - RUN + 1]
        place, runs = np.concatenate([place, owner[: len(within)][within]]), np.concatenate([runs, windows(lines.tokens, RUN)[within]])
    order = np.lexsort((runs, place))
    place, runs = place[order], runs[order]
    new = np.append(True, (place[1:] != place[:-1]) | (runs[1:] != runs[:-1]))[: len(place)]
    place, runs = place[new], runs[new]
    kept = np.arange(len(place)) - np.searchsorted(place, place) < SKETCH
    return runs[kept], np.concatenate([[0], np.cumsum(np.bincount(place[kept], minlength=len(sizes)))])


def _read(depth: int, sketched: bool, sieve=None):
    """Rows of SKETCHES or of LINES: each line once for each document; of LINES those whose leaf the sieve finds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                lines = Lines([t or b"" for t in as_bytes(batch.column(1))], depth)
                lines.keep(first_of(lines.doc, lines.line))
                if sieve is not None:
                    lines.keep(sieve.value.test(lines.leaf))
                if sketched:
                    values, ends = sketches_of(lines)
                    leaf = pa.array(lines.leaf, mask=~first_of(lines.doc, lines.leaf))
                else:
                    values, ends = lines.tokens, np.concatenate([[0], np.cumsum(lines.size)])
                    leaf = pa.array(lines.leaf)
                arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lines.doc)), leaf, pa.array(lines.line), arrays], names=(SKETCHES if sketched else LINES).names)

    return read


def sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def surroundings(sketches: DataFrame, candidates: DataFrame, min_docs: int) -> DataFrame:
    """id, own, others: a document's id, the smallest hash of its own lines, and the smallest recurring hashes of two of its lines. candidates: line."""
    runs = sketches.select("doc_id", "line", F.explode("runs").alias("run"))
    common = stash(runs.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("run", F.lit(True).alias("common")))
    by_line = (
        runs.join(sent(common), "run", "left")
        .groupBy("doc_id", "line")
        .agg(F.min(F.when(F.col("common").isNull(), F.col("run"))).alias("fresh"), F.min(F.when(F.col("common"), F.col("run"))).alias("low"))
        .join(sent(candidates.withColumn("candidate", F.lit(True))), "line", "left")
    )
    own = F.when(F.col("low").isNull() & F.col("candidate").isNull(), F.col("fresh"))
    low = F.when(F.col("low").isNotNull(), F.struct("low", "line"))
    return by_line.groupBy(F.col("doc_id").alias("id")).agg(F.min(own).alias("own"), F.slice(F.array_sort(F.collect_set(low)), 1, 2).alias("others"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> tuple[DataFrame, Sieve]:
    """A table of the hashes of the lines that have a recurring template, and a sieve of the ids of documents with such lines."""
    texts = docs.select("doc_id", "text")
    sketches = stash(texts.mapInArrow(_read(depth, True), SKETCHES))
    leaves = stash(sketches.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    sieve = texts.sparkSession.sparkContext.broadcast(Sieve(leaves))
    lines = stash(texts.mapInArrow(_read(depth, False, sieve), LINES).join(sent(leaves), "leaf", "left_semi"))
    distinct = stash(lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.any_value("tokens").alias("tokens")))
    at = distinct.select("leaf", "line", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token"))
    constant = at.groupBy("leaf", "place", "token").agg(F.sum("n").alias("with")).where(F.col("with") >= min_docs)
    template = F.sum(F.when(F.col("with").isNotNull(), F.xxhash64("place", "token") % 1_000_000_007_000)).alias("template")
    templates = (
        at.join(constant, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "line", "size")
        .agg(template, F.count("with").alias("constants"))
        .where(F.col("constants") >= similarity * F.col("size"))
        .select("leaf", "line", F.xxhash64("leaf", "constants", "template").alias("template"))
    )
    shaped = stash(lines.select("doc_id", "leaf", "line").join(templates, ["leaf", "line"]))
    held = shaped.groupBy("template", "doc_id").agg(F.min("line").alias("line"))
    enough = stash(held.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template"))
    shaped = stash(shaped.join(sent(enough), "template", "left_semi").select("template", "doc_id", "line"))
    around = surroundings(sketches, stash(shaped.select("line").distinct()), min_docs)
    other = F.coalesce("own", F.expr("get(filter(others, x -> x.line <> line), 0).low"), F.lit(0))
    recurring = stash(
        shaped.groupBy("template", "doc_id")
        .agg(F.min("line").alias("line"))
        .join(around, F.col("doc_id").eqNullSafe(F.col("id")))
        .select("template", other.alias("around"))
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("different"))
        .where(F.col("different") >= min_docs)
        .select("template")
    )
    # a template may hold a large share of all lines, so rows are not dealt by it if the list of templates can be sent
    held = stash(shaped.join(sent(recurring), "template", "left_semi").select("doc_id", "line"))
    gone, owners = stash(held.select("line").distinct()), Sieve(held.where("doc_id is not null").select("doc_id"))
    discard(sketches, leaves, lines, distinct, shaped, enough, held)
    return gone, owners


def _cleaned(schema: T.StructType, gone, owners, counted: bool):
    """Drops the lines in gone, a sorted array that is not empty; n_dropped_lines adds to what earlier blocks dropped."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            counts = batch.column("n_dropped_lines").to_pylist() if counted else [0] * len(batch)
            ids = batch.column("doc_id")
            met = owners.value.test(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(met).tolist()
            lines = Lines([texts[i] or b"" for i in asked])
            known = gone.value
            hit = known[np.minimum(np.searchsorted(known, lines.line), len(known) - 1)] == lines.line
            dropped: dict[int, set[int]] = {}
            for i, nth in zip(lines.doc[hit].tolist(), lines.nth[hit].tolist(), strict=True):
                dropped.setdefault(asked[i], set()).add(nth)
            for i, which in dropped.items():
                texts[i] = b"\n".join(line for nth, line in enumerate(texts[i].split(b"\n")) if nth not in which)
                counts[i] += len(which)
            out = {"text": pa.array(texts, pa.binary()).cast(pa.string())} | ({"n_dropped_lines": pa.array(counts, pa.int64())} if counted else {})
            yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(c) for c in schema.names], names=schema.names)

    return clean


def drop_recurring_lines(docs: DataFrame, counted: bool = False, block: int = BLOCK, **options) -> DataFrame:
    """docs, all columns, without the lines of recurring templates; if counted, with n_dropped_lines (a column of that name is replaced).
    Texts are not shuffled: the lines' hashes are sent to the tasks in blocks of `block`, and each line is judged where it is read."""
    spark = docs.sparkSession
    gone, owners = recurring_lines(docs, **options)
    owners = spark.sparkContext.broadcast(owners)
    parts = -(-gone.count() // block)
    if counted:
        docs = docs.drop("n_dropped_lines").withColumn("n_dropped_lines", F.lit(0).cast("long"))
    schema = docs.schema
    for i in range(parts):
        own = gone.where(F.pmod(F.xxhash64("line"), F.lit(parts)) == i).toArrow()["line"].to_numpy()  # about `block` longs
        if not len(own):
            continue
        own = np.sort(own)
        docs = docs.mapInArrow(_cleaned(schema, spark.sparkContext.broadcast(own), owners, counted), schema)
    return docs


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned texts, with their number of dropped lines."""
    return drop_recurring_lines(load(spark, sf_dir, "documents"), counted=True).select("doc_id", "text", "n_dropped_lines")
