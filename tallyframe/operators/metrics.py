"""Classification metrics over a scored table."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expressions import number
from tallyframe.operators.quantiles import RANGE_ROWS, in_ranges
from tallyframe.session import checkpointed, quoted


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((quoted(label) == quoted(prediction)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = quoted(label), quoted(prediction)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Undefined ratios count as 0. In the accuracy row all three measures show the accuracy.
    """
    cm = confusion_matrix(df, label, prediction)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def scores(hit, predicted, actual):
        p, r = ratio(hit, predicted), ratio(hit, actual)
        return p, r, ratio(2 * p * r, p + r)

    zero, one = scores(tn, tn + fn, tn + fp), scores(tp, tp + fp, tp + fn)
    n0, n1 = tn + fp, tp + fn
    n = n0 + n1
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [ratio(a * n0 + b * n1, n) for a, b in zip(zero, one)]
    rows = [("0", zero, n0), ("1", one, n1), ("accuracy", [ratio(tn + tp, n)] * 3, n),
            ("macro avg", macro, n), ("weighted avg", weighted, n)]
    return cm.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), m[0].alias("precision"), m[1].alias("recall"),
                 m[2].alias("f1_score"), support.alias("support"))
        for name, m, support in rows
    ])))


def score_steps(df: DataFrame, label: str, score: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per distinct score with its positives and negatives and the totals above it.

    Equal scores are merged before anything is ordered. The running totals are taken inside score ranges of
    about `range_rows` distinct scores and shifted by the totals of the ranges above.
    """
    scored = df.select(number(df, score).alias("score"), quoted(label).alias("y")).where("score IS NOT NULL")
    steps = checkpointed(scored.groupBy("score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))
    ranged = in_ranges(steps, "score", steps.count(), range_rows)
    inside = Window.partitionBy("part").orderBy(F.desc("score"))
    ranged = ranged.select(
        "part", "score", "pos", "neg", F.sum("pos").over(inside).alias("tp"), F.sum("neg").over(inside).alias("fp"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = ranged.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"))
    return ranged.join(F.broadcast(shift), "part").select(
        "score", "pos", "neg", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"))


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", range_rows: int = RANGE_ROWS) -> DataFrame:
    """`roc_auc` (ties count half) and `pr_auc` (average precision by steps) in one pass."""
    steps = score_steps(df, label, score, range_rows)
    p, n = F.sum("pos"), F.sum("neg")
    beaten = F.sum(F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos") / 2))
    precision = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp").cast("double") + F.col("fp")))
    return steps.agg(
        F.try_divide(beaten, p.cast("double") * n.cast("double")).alias("roc_auc"),
        F.try_divide(precision, p.cast("double")).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("pr_auc")


def compare_models(spark, results: dict[str, dict], by: str = "pr_auc") -> tuple[DataFrame, str]:
    """(comparison table in training order, name of the best model); the first trained wins a tie."""
    rows = [(i, name, r["accuracy"], r["roc_auc"], r["pr_auc"]) for i, (name, r) in enumerate(results.items())]
    table = spark.createDataFrame(
        rows, "trained int, model string, accuracy double, roc_auc double, pr_auc double")
    best = max(rows, key=lambda r: (r[2 + ("accuracy", "roc_auc", "pr_auc").index(by)] or -math.inf, -r[0]))
    return table, best[1]
