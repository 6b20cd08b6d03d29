import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyframe.operators import boosting, metrics, models
from tallyframe.operators.boosting import BoostedTrees, BoostedTreesModel


def noisy(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n).round(2), rng.integers(0, 4, n), rng.random(n) < 0.002, rng.normal(size=n)].astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - (x[:, 1] == 2) * 3 + x[:, 2])))).astype(float)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = noisy(3000)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, target double")
    return df.select(array_to_vector("x").alias("features"), "target").repartition(3).persist(), x, y


def plain_trees(x, y, rounds, depth, step=0.1, penalty=1.0, least=1.0):
    """Margins after every round, splitting at every value that quantiles of 256 steps can give."""
    cuts = [sorted({v for v in np.quantile(c, np.arange(256) / 256) if v < c.max()}) for c in x.T]
    margin, out = np.zeros(len(x)), []

    def grow(rows, g, h, level):
        best = None
        for f, own in enumerate(cuts if level else []):
            for c in own:
                left = rows & (x[:, f] <= c)
                hl, hr = h[left].sum(), h[rows & ~left].sum()
                if min(hl, hr) < least:
                    continue
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
                gain = 0.5 * (score(left) + score(rows & ~left) - score(rows))
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, left
        if best is None:
            margin[rows] += -g[rows].sum() / (h[rows].sum() + penalty) * step
            return
        grow(best[1], g, h, level - 1)
        grow(rows & ~best[1], g, h, level - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.ones(len(x), bool), p - y, p * (1 - p), depth)
        out.append(margin.copy())
    return out


def margins(model, df):
    p = np.array([r["probability"][1] for r in model.transform(df).select("probability").collect()])
    return np.log(p / (1 - p))


@pytest.mark.parametrize("limit", [boosting.DRIVER_BYTES, 0])
def test_trees_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(boosting, "DRIVER_BYTES", limit)
    monkeypatch.setattr(boosting, "PENDING_TREES", 2)
    x, y = noisy(300, 2)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, target double") \
        .select(array_to_vector("x").alias("features"), "target").coalesce(2)
    model = BoostedTrees(labelCol="target", rounds=3, maxDepth=2, rowShare=1.0, featureShare=1.0).fit(df)
    assert np.allclose(margins(model, df), plain_trees(x, y, 3, 2)[-1], atol=1e-9)


def test_loss_falls_and_the_model_is_as_good_as_it_can_be(spark, table, tmp_path):
    df, x, y = table
    model = BoostedTrees(labelCol="target", rounds=12, maxDepth=3, stepSize=0.3).fit(df)
    trees = model.all_trees()
    losses = []
    for k in range(0, 13, 3):
        cut = BoostedTreesModel("features", __import__("json").dumps(trees[:k]), 4)
        rows = cut.transform(df).select("target", "probability").collect()
        p = np.array([r["probability"][1] for r in rows])
        t = np.array([r["target"] for r in rows])
        losses.append(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    best = -(1 / (1 + np.exp(-(2 * x[:, 0] - (x[:, 1] == 2) * 3 + x[:, 2]))))
    scored = models.score(model, df.withColumn("target", F.col("target").cast("int")))
    auc = metrics.ranking_metrics(scored.select("target", "probability_high"), "target", "probability_high").first()["roc_auc"]
    order = np.argsort(best)
    ranks = np.empty(len(y))
    ranks[order] = np.arange(len(y), 0, -1)
    ideal = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert ideal - 0.02 < auc < 1
    weights = model.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1) and weights[:2].min() > weights[3]
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = BoostedTreesModel.load(str(tmp_path / "model"))
    assert np.allclose(margins(loaded, df), margins(model, df))


def test_shares_of_rows_and_columns():
    rows = np.arange(200_000)
    first, second = boosting._drawn(rows, 42, 0, 0.8), boosting._drawn(rows, 42, 1, 0.8)
    assert abs(first.mean() - 0.8) < 0.01 and abs((first & second).mean() - 0.64) < 0.01
    assert boosting._drawn(rows, 42, 0, 1.0).mean() > 0.999


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0)] * 5, "x array<double>, target double").select(array_to_vector("x").alias("features"), "target")
    model = BoostedTrees(labelCol="target", rounds=2).fit(df)
    assert all(r["prediction"] == 1.0 for r in model.transform(df).collect())
    assert BoostedTrees(labelCol="target", rounds=2).fit(df.limit(0)).transform(df.limit(0)).count() == 0
