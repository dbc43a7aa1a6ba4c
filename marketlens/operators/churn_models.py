"""Churn models: training, validation, comparison and scored output."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CUSTOMER, scalar
from ..functions.ordering import global_row_number
from ..functions.staging import materialize
from . import metrics
from .boosting import BoostedModel, Settings, fit_boosted
from .churn import FEATURES

LABEL = "churned"


def with_vector(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    ready = df.dropna(subset=[*features, LABEL])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(ready)


def with_weight(df: DataFrame, kind: str = "balanced", label: str = LABEL) -> DataFrame:
    """Add ``weight``: classes balanced, or positives raised to the negatives."""
    t = df.agg(
        F.struct(F.count(label).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).alias("t")
    ).scalar()
    n, pos = t.getField("n"), t.getField("pos")
    neg = n - pos
    y = F.col(label)
    if kind == "balanced":
        weight = n / (2 * F.when(y == 1, pos).otherwise(neg))
    elif kind == "positive":
        weight = F.when(y == 1, neg / pos).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown weight: {kind}")
    return df.withColumn("weight", weight.cast("double"))


def train_rf(train: DataFrame, trees: int = 100, depth: int = 6, balanced: bool = True, seed: int = 42) -> Model:
    """Random forest. ``depth=30, balanced=False`` is the unrestricted variant."""
    rf = RandomForestClassifier(labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed)
    if balanced:
        return rf.setWeightCol("weight").fit(with_weight(train))
    return rf.fit(train)


def train_lr(train: DataFrame, iterations: int = 300) -> Model:
    """Balanced logistic regression with the penalty of one unit per data set."""
    weighted = with_weight(train)
    n = max(train.count(), 1)
    return LogisticRegression(labelCol=LABEL, weightCol="weight", maxIter=iterations, regParam=1.0 / n).fit(weighted)


def train_gbt(train: DataFrame, rounds: int = 100, depth: int = 6, rate: float = 0.3) -> BoostedModel:
    """Second-order boosted trees with positives weighted by the class ratio. ``train`` should be a written table."""
    return fit_boosted(train, LABEL, settings=Settings(rounds, depth, rate))[0]


def score(model: Model | BoostedModel, test: DataFrame) -> DataFrame:
    """Features with the actual label, the prediction and its probability."""
    out = model.transform(test)
    positive = F.col("positive") if isinstance(model, BoostedModel) else vector_to_array("probability")[1]
    return out.withColumns(
        {
            metrics.LABEL: F.col(LABEL).cast("int"),
            metrics.PREDICTED: F.col("prediction").cast("int"),
            metrics.SCORE: positive,
        }
    ).drop("features", "rawPrediction", "prediction", "positive", LABEL)


def dummy_baseline(train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    """Accuracy of always answering the training majority; ties answer 0."""
    majority = scalar(train, (F.count_if(F.col(label) == 1) > F.count_if(F.col(label) == 0)).cast("int"))
    hit = (F.col(label) == F.col("_majority")).cast("int")
    return test.withColumn("_majority", majority).agg((F.sum(hit) / F.count(hit)).alias("baseline_accuracy"))


def with_folds(df: DataFrame, label: str = LABEL, key: str = CUSTOMER, folds: int = 3, seed: int = 7, out: str = "fold") -> DataFrame:
    """Add a fold number such that the folds' counts of a class differ by at most one.

    The rows of a class are dealt out in turn, in the order of a hash of their
    key: the whole table is numbered class by class across the cluster, and a
    row's place in its class is its number less those of the classes before. No
    class is gathered. ``key`` is unique; ``df`` is read several times and
    should be a written table.
    """
    dealt = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    numbered = global_row_number(df, [label, dealt, key], "_place", written=True)
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("n"))
    behind = F.sort_array(F.collect_list(F.struct("_class", "n")))  # one entry per class
    classes = sizes.agg(behind.alias("c")).scalar()
    before = F.aggregate(
        F.filter("_classes", lambda c: ~c["_class"].eqNullSafe(F.col(label)) & (c["_class"].isNull() | (c["_class"] < F.col(label)))),
        F.lit(0).cast("bigint"),
        lambda total, c: total + c["n"],
    )
    placed = numbered.withColumn("_classes", classes).withColumn(out, F.pmod(F.col("_place") - 1 - before, F.lit(folds)).cast("int"))
    return placed.drop("_place", "_classes")


def cross_val(train_model: Callable[[DataFrame], Model | BoostedModel], df: DataFrame, folds: int = 3, key: str = CUSTOMER) -> list[float]:
    """Accuracy on each held-out fold of stratified folds. ``df`` should be a written table.

    The boosted trees of all folds are grown in the same passes.
    """
    placed = materialize(with_folds(df, key=key, folds=folds, out="_fold"), "folds")
    boosted = fit_boosted(placed, LABEL, "_fold", range(folds)) if train_model is train_gbt else None
    out = []
    for i in range(folds):
        model = boosted[i] if boosted else train_model(placed.where(F.col("_fold") != i))
        held_out = model.transform(placed.where(F.col("_fold") == i))
        hit = (F.col("prediction") == F.col(LABEL)).cast("int")
        accuracy = held_out.agg((F.sum(hit) / F.count(hit)).alias("a")).first()["a"]
        if accuracy is not None:
            out.append(float(accuracy))
    return out


def importances(model: Model | BoostedModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Share of each feature in the tree splits (of boosted trees, in the mean gain), largest first."""
    values = model.importances if isinstance(model, BoostedModel) else model.featureImportances.toArray()
    spark = SparkSession.active()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass(frozen=True)
class ModelResult:
    name: str
    scored: DataFrame
    cross_val: float


def compare_models(results: Sequence[ModelResult]) -> DataFrame:
    """One line per model, best F1 of the churned class first."""
    lines = None
    for r in results:
        report = metrics.class_report(r.scored)
        one = F.col("class") == "1"
        summary = report.agg(
            F.max(F.when(F.col("class") == "accuracy", F.col("f1_score"))).alias("accuracy"),
            F.max(F.when(one, F.col("precision"))).alias("precision"),
            F.max(F.when(one, F.col("recall"))).alias("recall"),
            F.max(F.when(one, F.col("f1_score"))).alias("f1_score"),
        )
        roc_auc = metrics.auc(r.scored).scalar()
        line = summary.select(F.lit(r.name).alias("model"), "*", roc_auc.alias("roc_auc"), F.lit(r.cross_val).alias("cross_val"))
        lines = line if lines is None else lines.unionByName(line)
    return lines.orderBy(F.desc("f1_score"), "model")
