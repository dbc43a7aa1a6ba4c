"""Classification metrics as aggregates over a scored table.

The table holds a 0/1 label, a 0/1 prediction and a probability per row. The
curves need the rows in score order; they work on counts per distinct score
with cluster-wide running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import down, running_sum
from ..functions.staging import materialize

LABEL, PREDICTED, SCORE = "actual", "predicted", "probability"


def _cells(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion(df: DataFrame, label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:
    """Counts of label x prediction, all four cells."""
    cells = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    rows = [F.struct(F.lit(a).alias(label), F.lit(p).alias(predicted), F.col(c).alias("count")) for c, a, p in cells]
    return _cells(df, label, predicted).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_report(df: DataFrame, label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and the means."""
    c = _cells(df, label, predicted)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    c = c.select(
        _ratio(tn, tn + fn).alias("p0"),
        _ratio(tn, tn + fp).alias("r0"),
        _ratio(2.0 * tn, 2 * tn + fn + fp).alias("f0"),
        (tn + fp).alias("s0"),
        _ratio(tp, tp + fp).alias("p1"),
        _ratio(tp, tp + fn).alias("r1"),
        _ratio(2.0 * tp, 2 * tp + fn + fp).alias("f1"),
        (tp + fn).alias("s1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )
    n = F.col("s0") + F.col("s1")

    def macro(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return _ratio(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), n)

    def line(name, p, r, f, s):
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), s.alias("support")
        )

    acc = F.col("acc")
    rows = [
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", acc, acc, acc, n),
        line("macro avg", macro("p"), macro("r"), macro("f"), n),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), n),
    ]
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ranked(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, highest first: positives and negatives so far."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return materialize(running_sum(counts, [down("threshold")], {"pos": "tps", "neg": "fps"}), "ranked")


def _totals(ranked: DataFrame):
    t = ranked.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    return t.getField("p"), t.getField("n")


def roc(df: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """One point per distinct score; the origin has no threshold."""
    ranked = _ranked(df, label, score)
    p, n = _totals(ranked)
    points = ranked.select("threshold", F.try_divide(F.col("fps"), n).alias("fpr"), F.try_divide(F.col("tps"), p).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def auc(df: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    ranked = _ranked(df, label, score)
    # twice the area in whole numbers, so that the sum is exact
    area = F.sum((F.col("neg") * (2 * F.col("tps") - F.col("pos"))).cast("decimal(38,0)")).cast("double")
    box = 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.when(box > 0, area / box).alias("auc"))


def pr_curve(df: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Precision and recall per distinct score, ending at precision 1, recall 0."""
    ranked = _ranked(df, label, score)
    p, _ = _totals(ranked)
    points = ranked.select(
        "threshold",
        (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
        F.try_divide(F.col("tps"), p).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)
