import numpy as np
from pyspark.sql import functions as F

from tallyframe.operators import forest
from tallyframe.operators.blocks import blocks, distinct, packed, unpacked
from tallyframe.operators.forest import RandomForest
from test_forest import frame


def test_distinct_rows():
    x = np.array([[1.0, np.nan], [1.0, np.nan], [2.0, np.nan], [1.0, 3.0], [-0.0, 3.0], [0.0, 3.0]])
    code, first = distinct(x, np.array([0, 0, 0, 0, 1, 1]))
    assert code.tolist() == [0, 0, 1, 2, 3, 3] and first.tolist() == [0, 2, 3, 4]
    code, first = distinct(np.zeros((3, 0)), np.array([1, 0, 1]))
    assert code.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_equal_rows_are_held_once_and_all_rows_come_back(spark):
    rows = spark.range(60_000, numPartitions=2).select(
        F.col("id").alias("row"), (F.col("id") % 2).cast("double").alias("y"),
        F.array((F.col("id") % 10).cast("double"), (F.col("id") % 3).cast("double")).alias("x"))
    for block_bytes in (1 << 20, 100_000):  # blocks of distinct rows, cut or not
        stored = packed(rows, np.int32, block_bytes=block_bytes)
        held = [(b.row, b.place, b.y, b.x) for _, b in blocks(stored.toArrow().to_batches(), np.int32)]
        assert all(len(y) == 30 for _, _, y, _ in held)  # 2 and 10 aren't apart
        row, y, x = (np.concatenate(v) for v in zip(*((row, y[place], x[place]) for row, place, y, x in held)))
        assert sorted(row) == list(range(60_000)) and (y == row % 2).all() and (x == np.c_[row % 10, row % 3]).all()
        assert stored.selectExpr("sum(n)", "max(last)", "max(width)").first()[:] == (60_000, 1.0, 2)
        assert unpacked(stored, 2, np.int32).groupBy("x0").count().where("count = 6000").count() == 10


def test_a_level_in_several_passes_and_the_count_of_rows_sent(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 6, (3000, 3)).astype(float), rng.integers(0, 2, 3000)
    df = frame(spark, x, y)
    whole = RandomForest(labelCol="target", trees=3, keyCol="i", taskBytes=20_000).fit(df)
    monkeypatch.setattr(forest, "PASS_CELLS", 1)
    cut = RandomForest(labelCol="target", trees=3, keyCol="i", taskBytes=20_000).fit(df)
    assert all((a[k] == b[k]).all() for a, b in zip(whole.trees, cut.trees) for k in ("feature", "cut", "left", "right"))
    top = {"feature": np.array([0, -1, -1]), "cut": np.array([2.0, 0, 0]), "left": np.array([1, 0, 0]), "right": np.array([2, 0, 0])}
    parts = dict(forest.rows_of(top, x.T, {1: None, 2: None}))
    assert (x[parts[1], 0] <= 2).all() and (x[parts[2], 0] > 2).all() and sum(map(len, parts.values())) == 3000
