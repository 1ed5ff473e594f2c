"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates of whole texts: densities of a fixed word list and of a list learned from the training labels,
second-person words near listed words, capitals, punctuation, and obfuscated spellings (signs within words, repeated letters).
Labels of training rows alone are learned from; no id, source, language or label is an input.

The learned list holds the words with the highest log odds of a toxic label, LEXICON at most. Labelled training
rows are sampled by hash of the id, TRAIN_TOXIC + CALIBRATE / 4 toxic and TRAIN_CLEAN + CALIBRATE clean ones at most; trees and list
are fitted on about half of them, the calibration on the others, weighted to the labels' shares among all training rows. Null and empty texts have all features 0 and get the score that such features get. Rows
without a label are scored like others. A row without an id has no label and isn't held out; repeated rows, and rows of one id, are
scored each by their own text, and of several labels of an id the toxic one holds. Texts of equal features have equal scores. Very long
texts are read whole; only doc_id and text are read. Without training rows of both labels every score is the share of toxic labels.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import as_bytes, load, stash

LEXICON = 200
TRAIN_TOXIC, TRAIN_CLEAN, CALIBRATE = 8_000, 16_000, 20_000
TREES, DEPTH, REACH = 20, 4, 6
CUT = 0.7

#: Insults in the languages of the corpus; words that address a person.
INSULTS = frozenset(
    w.encode()
    for w in (
        "idiot idiots stupid moron morons loser losers pathetic scum trash garbage clown worthless dumb fool jerk ugly disgusting hate kill shut shit fuck fucking fucked bitch bastard asshole ass crap damn retard cunt dick whore slut"
        " pig vermin filth coward liar imbecile cretin dimwit"
        " connard connasse salope merde putain crétin abruti débile ordure enculé pute"
        " arschloch scheisse scheiße trottel hurensohn schlampe wichser depp dummkopf blödmann abschaum"
        " puta mierda imbécil estúpido estúpida gilipollas cabrón pendejo basura idiota tonto asqueroso"
    ).split()
)
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros vuestro".split())
#: Signs that stand for letters.
DISGUISED = bytes.maketrans(b"@$013457!", b"asoieasti")
PUNCTUATION, UPPER, LETTERS = string.punctuation.encode(), string.ascii_uppercase.encode(), string.ascii_letters.encode()

FEATURES = ("insults", "insult_share", "distinct_insults", "learned", "learned_share", "odds_sum", "odds_rate", "near_second_person", "second_person", "capitals", "punctuation", "exclamations", "obfuscated", "stretched", "log_words", "mean_length")
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType()))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a row without an id isn't held out


def _bare(word: bytes) -> bytes:
    return word.strip(PUNCTUATION)


def features(text: bytes, learned: dict[bytes, float]) -> list[float]:
    """One value for each of FEATURES; learned: words and their log odds."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    bare: Counter[bytes] = Counter()
    disguised = stretched = 0
    for w, c in counts.items():
        core = _bare(w)
        bare[core] += c
        if core and not core.isalpha() and (plain := core.translate(DISGUISED)) != core and plain in INSULTS:
            disguised += c
            bare[plain] += c
        elif len(core) > 3 and any(core[i] == core[i + 1] == core[i + 2] for i in range(len(core) - 2)):
            stretched += c
    listed = {w: c for w, c in bare.items() if w in INSULTS}
    known = {w: c for w, c in bare.items() if w in learned}
    insults, second = sum(listed.values()), sum(c for w, c in bare.items() if w in SECOND_PERSON)
    near = 0
    if second and (listed or known):
        cores = [_bare(w) for w in words]
        for i, w in enumerate(cores):
            if w in listed or w in known:
                near += not SECOND_PERSON.isdisjoint(cores[max(0, i - REACH) : i + REACH + 1])
    odds = sum(learned[w] * c for w, c in known.items())
    size = len(text)
    letters = max(1, size - len(text.translate(None, LETTERS)))
    return [
        float(insults), insults / n, float(len(listed)), float(sum(known.values())), sum(known.values()) / n, odds, odds / n, near / n, second / n,
        (size - len(text.translate(None, UPPER))) / letters, (size - len(text.translate(None, PUNCTUATION))) / size, text.count(b"!") / n, disguised / n, stretched / n, float(np.log1p(n)), size / n,
    ]


def learn_lexicon(labelled: DataFrame, size: int = LEXICON) -> dict[bytes, float]:
    """labelled: text, toxic, of training rows. The words most telling of a toxic label, with their log odds."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[bool(toxic)].update({_bare(w) for w in (text or b"").lower().split()})
            if sum(map(len, counts)) > 500_000:
                yield from flush(counts)
        yield from flush(counts)

    def flush(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        every = [w for w in counts[0].keys() | counts[1].keys() if w]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([counts[1][w] for w in every], pa.int64()), pa.array([counts[0][w] for w in every], pa.int64())], names=["word", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()

    totals = labelled.agg(F.sum(F.col("toxic")).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic or not clean:
        return {}
    counted = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(words, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    # in at least a thousandth of toxic texts, and three
    best = counted.where(F.col("toxic") >= max(3, toxic / 1000)).select("word", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "word").limit(size)
    return {bytes(r["word"]): r["odds"] for r in best.collect()}


def with_features(docs: DataFrame, learned: dict[bytes, float]) -> DataFrame:
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t or b"", learned) for t in as_bytes(batch.column(1))], pa.list_(pa.float64()))], names=SCORED.names)

    return docs.select("doc_id", "text").mapInArrow(rate, SCORED)


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the scores' break points and the rising shares of label 1, drawn towards the mean by one row."""
    order = np.argsort(scores, kind="stable")
    mean = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    pools: list[list[float]] = []  # sum, weight, lowest score, highest
    for s, y, n in zip(scores[order].tolist(), labels[order].tolist(), weights[order].tolist(), strict=True):
        pools.append([y * n, n, s, s])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            a, w, _, high = pools.pop()
            pools[-1][0] += a
            pools[-1][1] += w
            pools[-1][3] = high
    x = np.array([p for pool in pools for p in pool[2:]])
    y = np.repeat(np.maximum.accumulate([(a + mean) / (w + 1) for a, w, _, _ in pools]), 2)
    return x, np.clip(y, 0, 1)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Labels join the documents by id; texts aren't shuffled twice."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    # bounded samples by hash
    part = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(n)
    chosen = stash(part(1, TRAIN_TOXIC + CALIBRATE // 4).unionByName(part(0, TRAIN_CLEAN + CALIBRATE)))
    shares = [{int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()} for rows in (known, chosen)]
    weight = {y: shares[0][y] / n for y, n in shares[1].items()}
    sample = stash(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    train = sample.where(fold == 0)
    learned = learn_lexicon(train.select("text", "toxic"))
    rated = stash(with_features(sample, learned).join(chosen, "doc_id"))
    split = rated.select("doc_id", array_to_vector("features").alias("x"), F.col("toxic").cast("double").alias("label"), fold.alias("fold"))
    counts = {(r["fold"], r["label"]): r["count"] for r in split.groupBy("fold", "label").count().collect()}
    result = lambda score, rows: rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    if not counts.get((0, 0.0)) or not counts.get((0, 1.0)):
        toxic, every = sum(n * weight[int(y)] for (_, y), n in counts.items() if y), sum(n * weight[int(y)] for (_, y), n in counts.items())
        return result(F.lit(toxic / every if every else 0.0), docs)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=5, cacheNodeIds=False).fit(split.where("fold = 0").repartition(6, "doc_id"))
    raw = lambda rows: model.transform(rows).select("doc_id", F.element_at(vector_to_array("rawPrediction"), 2).alias("raw"), *[c for c in ("label",) if c in rows.columns])
    calibration = raw(split.where("fold = 1")).select("raw", "label").toPandas()  # CALIBRATE rows and a quarter at most
    x, y = isotonic(calibration["raw"].to_numpy(), calibration["label"].to_numpy(), calibration["label"].map(weight).to_numpy()) if len(calibration) else (np.array([0.0]), np.array([0.5]))
    return result(F.col("score"), _calibrated(raw(with_features(docs, learned).select("doc_id", array_to_vector("features").alias("x"))), x, y))


def _calibrated(rows: DataFrame, x: np.ndarray, y: np.ndarray) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_numpy(zero_copy_only=False)
            # within a pool scores rise a little with the raw value, so that ranking stays finer than the pools
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(0.98 * np.interp(raw, x, y) + 0.02 / (1 + np.exp(-2 * raw)), 0, 1))], names=["doc_id", "score"])

    return rows.mapInArrow(apply, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
