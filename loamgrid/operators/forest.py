"""Random forests on pixel tables, with splits by block, and what is measured on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.measures import counts, overall
from loamgrid.operators.selection import draw, first_rows

TREES, LEAF, DEPTH = 300, 20, 30
SEED = 42


def subsample(df: DataFrame, n: int | None, keys: list[str], seed: int = SEED, by: Column | None = None, bits: int = 63) -> DataFrame:
    """Exactly n rows drawn without replacement by a hash of their keys, or a given draw of so many bits; df itself if it has no more or n is None."""
    return df if n is None else first_rows(df, n, draw(*keys, seed=seed) if by is None else by, keys, bits)


def fit(train: DataFrame, features: list[str], label: str = "label", trees: int = TREES, depth: int = DEPTH, balanced: bool = False, seed: int = SEED) -> PipelineModel:
    """Three features are tried at each split, as the root of 15 is cut off. balanced: each class weighs the same."""
    indexer = StringIndexer(inputCol=label, outputCol="__index", stringOrderType="alphabetAsc").fit(train)
    parts = VectorAssembler(inputCols=features, outputCol="__features")
    tried = str(max(1, int(len(features) ** 0.5)))
    forest = RandomForestClassifier(labelCol="__index", featuresCol="__features", probabilityCol="__p", numTrees=trees, minInstancesPerNode=LEAF, maxDepth=depth, featureSubsetStrategy=tried, maxBins=128, seed=seed)
    rows = parts.transform(indexer.transform(train))
    if balanced:
        sizes = train.groupBy(label).agg(F.count("*").alias("__n"))
        total, classes = sizes.agg(F.sum("__n"), F.count("*")).first()
        rows = rows.join(F.broadcast(sizes), label).withColumn("__weight", F.lit(float(total) / classes) / F.col("__n"))
        forest = forest.setWeightCol("__weight")
    return PipelineModel([indexer, parts, forest.fit(rows)])


def classes_of(model: PipelineModel) -> list[int]:
    return [int(x) for x in model.stages[0].labels]


def save(model: PipelineModel, path: str) -> None:
    """Into a folder that all executors share; an older model there is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame, valid: Column | None = None) -> DataFrame:
    """df with pred (a class; 0 where a pixel isn't valid) and p (its probability for each class of the model, in order; none there)."""
    names = F.array(*[F.lit(c) for c in classes_of(model)])
    known, rest = (df, None) if valid is None else (df.where(valid), df.where(~F.coalesce(valid, F.lit(False))))
    scored = model.stages[2].transform(model.stages[1].transform(known))
    p = vector_to_array("__p")
    found = scored.withColumn("p", p).withColumn("pred", F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1)).select(*df.columns, "pred", "p")
    return found if rest is None else found.unionByName(rest.select("*", F.lit(0).alias("pred"), F.lit(None).cast("array<double>").alias("p")))


def evaluated(model: PipelineModel, test: DataFrame, classes: Sequence[int], label: str = "label") -> DataFrame:
    """One row of measures of agreement on the test side."""
    return overall(counts(predict(model, test), truth=label), classes)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by Gini importance, largest first."""
    names, values = model.stages[1].getInputCols(), model.stages[2].featureImportances.toArray().tolist()
    return sorted(zip(names, values, strict=True), key=lambda x: (-x[1], x[0]))


def out_of_fold(df: DataFrame, features: list[str], folds: int, fold: str = "fold", label: str = "label", **options) -> DataFrame:
    """Each row predicted by the model of the other folds. A class that a training side lacks is an error."""
    every = {r[0] for r in df.select(label).distinct().collect()}
    seed = options.pop("seed", SEED)
    found = None
    for k in range(folds):
        model = fit(df.where(F.col(fold) != k), features, label, seed=seed + k, **options)
        if set(classes_of(model)) != every:
            raise ValueError(f"fold {k} leaves no pixel of {sorted(every - set(classes_of(model)))} to learn from")
        own = predict(model, df.where(F.col(fold) == k))
        found = own if found is None else found.unionByName(own)
    return found


def leakage_sweep(train_blocked: DataFrame, test_blocked: DataFrame, train_random: DataFrame, test_random: DataFrame, features: list[str], sizes: list[int], keys: list[str], classes: Sequence[int], **options) -> list[tuple]:
    """(n, share of all eligible pixels, accuracy over blocks, accuracy at random, difference, macro F1 over blocks, at random, difference)
    for each training size that the blocked side has."""
    most = train_blocked.count()
    eligible, rows = most + test_blocked.count(), []
    for n in (n for n in sizes if n <= most):
        a, b = (evaluated(fit(subsample(x, n, keys), features, **options), y, classes).first() for x, y in ((train_blocked, test_blocked), (train_random, test_random)))
        rows.append((n, n / eligible, *(v for f in ("accuracy", "macro_f1") for v in (a[f], b[f], b[f] - a[f]))))
    return rows
