import random

import pytest

from tallyframe.operators import metrics

# label, score with one tie across the classes
SIX = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.5), (0, 0.5), (0, 0.2)]


def brute(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return auc, ap


def test_ranking_metrics_with_a_tie(spark):
    row = metrics.ranking_metrics(spark.createDataFrame(SIX, "label int, score double")).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(brute(SIX))


@pytest.mark.parametrize("range_rows", [7, 10 ** 6])
def test_ranking_metrics_by_ranges(spark, range_rows):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 3) if rng.random() < 0.7 else 0.5) for _ in range(900)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(4)
    row = metrics.ranking_metrics(df, range_rows=range_rows).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(brute(rows))
    moved = metrics.ranking_metrics(df.selectExpr("label", "exp(score * 3) AS score"), range_rows=range_rows).first()
    assert tuple(moved) == pytest.approx(tuple(row))


def test_one_class_has_no_ranking(spark):
    row = metrics.ranking_metrics(spark.createDataFrame([(0, 0.5)], "label int, score double")).first()
    assert tuple(row) == (None, None)


def test_report_counts_undefined_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    out = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert tuple(out["1"])[1:] == (0.0, 0.0, 0.0, 1)
    assert out["0"]["precision"] == pytest.approx(2 / 3) and out["accuracy"]["f1_score"] == pytest.approx(2 / 3)
    assert out["weighted avg"]["recall"] == pytest.approx(2 / 3) and out["macro avg"]["support"] == 3
    assert tuple(metrics.confusion_matrix(df).first()) == (2, 0, 1, 0)
    assert metrics.accuracy(df).first()[0] == pytest.approx(2 / 3)


def test_best_model_by_pr_auc_first_on_ties(spark):
    results = {"a": dict(accuracy=0.5, roc_auc=0.9, pr_auc=0.7), "b": dict(accuracy=0.6, roc_auc=0.8, pr_auc=0.7)}
    table, best = metrics.compare_models(spark, results)
    assert best == "a" and table.count() == 2
    assert metrics.compare_models(spark, results, by="accuracy")[1] == "b"


def test_ranking_metrics_of_very_large_classes(spark, monkeypatch):
    """5e9 rows per class in two steps: products of counts exceed 64 bits."""
    n = 5 * 10 ** 9
    steps = spark.createDataFrame([(0.9, 2 * n // 3, n // 3, 2 * n // 3, n // 3), (0.1, n - 2 * n // 3, n - n // 3, n, n)],
                                  "score double, pos long, neg long, tp long, fp long")
    monkeypatch.setattr(metrics, "score_steps", lambda *a: steps)
    row = metrics.ranking_metrics(steps).first()
    assert abs(row["roc_auc"] - 2 / 3) < 1e-6 and abs(row["pr_auc"] - (2 / 3 * 2 / 3 + 1 / 3 / 2)) < 1e-6
