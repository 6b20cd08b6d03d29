import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyframe.operators import forest, metrics, models
from tallyframe.operators.forest import RandomForest, RandomForestModel


def frame(spark, x, y, parts=3):
    rows = [(i, r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i int, x array<double>, target int").repartitionByRange(parts, "i") \
        .select("i", array_to_vector("x").alias("features"), "target")


def predicted(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("i").collect()])


def brute_force(x, y, classes=2):
    """Class shares per row of the tree that takes the split of least Gini impurity, and its depth."""
    chance = np.zeros((len(x), classes))

    def gini(rows):
        share = np.bincount(y[rows], minlength=classes) / len(rows)
        return len(rows) * (1 - (share ** 2).sum())

    def grow_(rows):
        chance[rows] = np.bincount(y[rows], minlength=classes) / len(rows)
        if len(set(y[rows])) < 2:
            return 0
        best = None
        for f in range(x.shape[1]):
            for cut in sorted(set(x[rows, f]))[:-1]:
                left = x[rows, f] <= cut
                total = gini(rows[left]) + gini(rows[~left])
                if best is None or total < best[0] - 1e-9:
                    best = total, rows[left], rows[~left]
        if best is None:
            return 0
        return 1 + max(grow_(best[1]), grow_(best[2]))

    return chance, grow_(np.arange(len(x)))


def chain(levels=44):
    """Rows with one set indicator, every other of which means class 1: a split can tell one indicator from the rest only."""
    x = np.repeat(np.eye(2 * levels), 2, axis=0)
    return x, np.repeat(np.arange(2 * levels) % 2, 2)


@pytest.mark.parametrize("task_bytes", [forest.TASK_BYTES, 4000])
def test_one_tree_equals_brute_force(spark, task_bytes):
    rng = np.random.default_rng(3)
    x = np.c_[rng.integers(0, 40, 400), rng.normal(size=400).round(1), rng.integers(0, 2, 400)].astype(float)
    y = ((x[:, 0] > 20).astype(int) + (x[:, 1] > 0.3) + (rng.random(400) < 0.2)) % 3
    df = frame(spark, x, y)
    model = RandomForest(labelCol="target", trees=1, looks=3, bootstrap=False, taskBytes=task_bytes).fit(df)
    found = np.array([r["probability"].toArray() for r in model.transform(df).orderBy("i").collect()])
    chance, _ = brute_force(x, y, 3)
    assert np.allclose(found, chance, atol=1e-6)  # fully grown: the leaves depend on the rows alone
    assert model.getOrDefault("classes") == 3


@pytest.mark.parametrize("task_bytes", [forest.TASK_BYTES, 20_000])
def test_trees_grow_beyond_forty_levels(spark, task_bytes):
    x, y = chain()
    df = frame(spark, x, y)
    model = RandomForest(labelCol="target", trees=1, looks=x.shape[1], bootstrap=False, taskBytes=task_bytes).fit(df)
    assert model.depths[0] >= 40 and model.depths[0] == brute_force(x, y)[1]
    assert (predicted(model, df) == y).all()
    shallow = RandomForest(labelCol="target", trees=1, maxDepth=5, looks=x.shape[1], bootstrap=False, taskBytes=task_bytes).fit(df)
    assert shallow.depths == [5] and (predicted(shallow, df) == y).mean() < 0.9


def test_size_of_a_task_does_not_change_the_trees(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (3000, 5)).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x[:, 0] - 15) / 3))).astype(int)
    df = frame(spark, x, y)
    whole, cut = (RandomForest(labelCol="target", trees=4, keyCol="i", taskBytes=b).fit(df) for b in (forest.TASK_BYTES, 30_000))
    a, b = ([r["probability"].toArray() for r in m.transform(df).orderBy("i").collect()] for m in (whole, cut))
    assert np.allclose(a, b) and whole.depths == cut.depths
    assert np.allclose(whole.featureImportances.toArray(), cut.featureImportances.toArray())
    assert whole.featureImportances.toArray().argmax() == 0


def test_many_trees_average_out_the_noise(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 4))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0] - 2 * x[:, 1]))).astype(int)
    train, test = frame(spark, x[:2000], y[:2000]), frame(spark, x[2000:], y[2000:])

    def auc(model):
        scored = models.score(model, test).select("target", "probability_high")
        return metrics.ranking_metrics(scored, "target", "probability_high").first()["roc_auc"]

    one, many = (models.forest(num_trees=t).fit(train) for t in (1, 40))
    assert auc(many) > 0.85 > auc(one)
    PipelineModel(stages=[many]).write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(loaded.stages[0], RandomForestModel)
    assert (predicted(loaded, test) == predicted(many, test)).all()
    assert np.allclose(loaded.stages[0].featureImportances.toArray(), many.featureImportances.toArray())


def test_passes_of_few_trees_give_the_same_forest(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 9, (500, 3)).astype(float), rng.integers(0, 2, 500)
    df = frame(spark, x, y)
    whole = RandomForest(labelCol="target", trees=5, keyCol="i").fit(df)
    monkeypatch.setattr(forest, "PASS_ROWS", 1000)
    cut = RandomForest(labelCol="target", trees=5, keyCol="i").fit(df)
    assert all((a[k] == b[k]).all() for a, b in zip(whole.trees, cut.trees) for k in ("feature", "cut", "left", "right"))


def test_draws():
    rows = np.arange(200_000)
    drawn = forest.times_drawn(rows, forest._key(42, 0))
    assert abs((drawn == 0).mean() - np.exp(-1)) < 0.005 and abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    other = forest.times_drawn(rows, forest._key(42, 1))
    assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.01
    first = np.bincount([forest.in_order(forest._key(42, i), 5)[0] for i in range(2000)], minlength=5)
    assert first.min() > 300


def test_one_class_constant_features_and_no_rows(spark):
    df = frame(spark, np.ones((6, 2)), np.ones(6, int))
    model = RandomForest(labelCol="target", trees=2).fit(df)
    assert (predicted(model, df) == 1).all() and model.depths == [0, 0]
    mixed = frame(spark, np.ones((6, 2)), np.array([0, 1] * 3))
    flat = RandomForest(labelCol="target", trees=1, bootstrap=False, taskBytes=1).fit(mixed)
    assert [r["probability"][1] for r in flat.transform(mixed).collect()] == [0.5] * 6
    with_null = df.withColumn("target", F.when(F.col("i") > 2, F.col("target")))
    assert (predicted(RandomForest(labelCol="target", trees=1).fit(with_null), df) == 1).all()
    assert RandomForest(labelCol="target", trees=2).fit(df.limit(0)).transform(df.limit(0)).count() == 0
