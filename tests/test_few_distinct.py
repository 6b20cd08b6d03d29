"""Jobs over many rows of few values: equal rows are worked out once, and results don't depend on it."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyframe.operators import boosting, forest, sampling
from tallyframe.operators.blocks import Block, Weighed, in_blocks, looked_up, weighed
from tallyframe.operators.boosting import BoostedTrees
from tallyframe.operators.features import normal_score
from tallyframe.operators.forest import RandomForest
from tallyframe.operators.quantiles import quantile_values
from test_boosting import margins, noisy, plain_trees
from test_forest import frame


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_weights_of_blocks_and_of_merged_blocks():
    rng = np.random.default_rng(1)
    x, y, row = rng.integers(0, 4, (5000, 2)).astype(float), rng.integers(0, 2, 5000).astype(float), np.arange(5000)
    draw = lambda r, t: r % (t + 2)
    parts = [Weighed.of_block(Block.of_rows(row[s], y[s], x[s]), draw, [0, 1], 2) for s in (slice(0, 3000), slice(3000, 5000))]
    (whole,) = in_blocks(iter(parts))
    assert whole.n == 5000 and len(whole.y) == 32 and whole.w.sum(1).tolist() == [draw(row, t).sum() for t in (0, 1)]
    for part in (whole, Weighed.of_block(Block.of_rows(row, y, np.c_[row, row].astype(float)), lambda r, t: r % 2, list(range(11)))):
        records = list(part.records(500))
        assert len(records) > 1 and sum(r["n"][0].as_py() for r in records) == 5000
        found = list(weighed(records, np.float64))
        assert (np.concatenate([f[1] for f in found]) == part.y).all() and (np.concatenate([f[2] for f in found]) == part.x).all()
        for t, w in enumerate(part.w):
            assert (np.concatenate([weights(t) for *_, weights in found]) == w).all()


def test_values_of_rows_are_looked_up():
    seen, known = [], {}

    def f(x):
        seen.append(len(x))
        return x.sum(1)

    x = np.array([[1.0, np.nan], [2.0, 3.0]])[np.arange(100) % 2]
    for _ in range(3):
        assert np.array_equal(looked_up(x, known, 10, f), x.sum(1), equal_nan=True)
    other = np.arange(100.0, 140.0).reshape(20, 2)
    assert (looked_up(other, known, 3, f) == other.sum(1)).all() and len(known) == 3
    assert (looked_up(other, {}, 3, f) == other.sum(1)).all() and seen == [2, 20, 20]


def test_draws_are_those_of_a_table_of_chances():
    rows = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63 - 1, 100_000)
    chance = (forest._mixed(rows.astype(np.uint64) ^ np.uint64(7)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    assert (forest.times_drawn(rows, 7) == np.searchsorted(forest.DRAWN, chance, "right")).all()


@pytest.mark.parametrize("limit", [boosting.DRIVER_BYTES, 0])
def test_trees_by_passes_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", limit)
    monkeypatch.setattr(boosting, "PENDING_TREES", 2)
    x, y = noisy(300, 2)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, target double") \
        .select(array_to_vector("x").alias("features"), "target").coalesce(2)
    model = BoostedTrees(labelCol="target", rounds=3, maxDepth=2, rowShare=1.0, featureShare=1.0).fit(df)
    assert np.allclose(margins(model, df), plain_trees(x, y, 3, 2)[-1], atol=1e-9)


def test_boosting_few_distinct_rows_takes_few_jobs(spark, monkeypatch):
    df = spark.range(40_000).select(
        array_to_vector(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5)).cast("double") for i in range(3)])).alias("features"),
        (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) == 0).cast("double").alias("target"))
    model, jobs = jobs_of(spark, "boosting", lambda: BoostedTrees(labelCol="target", rounds=25, maxDepth=4).fit(df))
    assert jobs < 25  # a level was a job
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    passes = BoostedTrees(labelCol="target", rounds=25, maxDepth=4).fit(df)
    assert np.allclose(margins(model, df.limit(200)), margins(passes, df.limit(200)), atol=1e-9)


def test_a_forest_of_few_distinct_rows_has_no_top_levels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (4000, 3)).astype(float)
    df = frame(spark, x, (rng.random(4000) < x[:, 0] / 4).astype(int), 6)
    whole = RandomForest(labelCol="target", trees=4, keyCol="i").fit(df)

    def none(*_):
        raise AssertionError("levels of all rows")

    with monkeypatch.context() as m:
        m.setattr(RandomForest, "_splits", none)
        few = RandomForest(labelCol="target", trees=4, keyCol="i", taskBytes=48 * 1100).fit(df)  # 128 rows differ
    m = RandomForest(labelCol="target", trees=4, keyCol="i", taskBytes=48 * 100).fit(df)
    for cut in (few, m):
        a, b = ([r["probability"].toArray() for r in f.transform(df).orderBy("i").collect()] for f in (whole, cut))
        assert np.allclose(a, b, atol=1e-6)


def test_samples_are_the_same_by_range_and_by_prefix_and_with_kept_hashes(spark, monkeypatch):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("target"), F.lit("x").alias("_hash0"))
    ids = lambda d: sorted(r["id"] for r in d.select("id").collect())

    def samples(hashed):
        small = sampling.downsample(df, "target", "id", hashed=hashed)
        assert small.columns == [*df.columns, *[hashed] * bool(hashed)]
        return [ids(small), *map(ids, sampling.stratified_split(small, "target", "id", hashed=hashed))]

    with monkeypatch.context() as m:
        m.setattr(sampling, "_last_by_prefix", None)  # class 0 is the lower part of its hashes: their largest tells how much
        found = samples("hash")
    assert found == samples("")
    monkeypatch.setattr(sampling, "NEAR_ROWS", 0)
    assert found == samples("hash") and [len(f) for f in found] == [6000, 4200, 1800]


def test_quantiles_of_rows_that_stand_for_several(spark):
    rng = np.random.default_rng(4)
    values, n = rng.normal(size=3000).round(2), rng.integers(1, 9, 3000)
    rows = [(None if i % 50 == 0 else float(v), float(i % 7), int(k)) for i, (v, k) in enumerate(zip(values, n))]
    df = spark.createDataFrame(rows, "a double, b double, n int").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.777, 1.0]
    for pass_cells, fetch_rows in ((1024, 0), (1 << 18, 1 << 18), (64, 2000)):
        found = quantile_values(df, ["a", "b"], probs, pass_cells, fetch_rows, weight="n")
        for i, c in enumerate("ab"):
            long = np.concatenate([np.full(r[2], r[i]) for r in rows if r[i] is not None])
            assert np.allclose(found[c], np.quantile(long, probs), rtol=1e-12, atol=1e-12)


def test_blocks_of_other_numbers():
    x, row = np.arange(12.0).reshape(6, 2), np.arange(6) + 10
    block = Block.of_rows(row, np.array([0.0, 0, 0, 1, 1, 1]), x).coded(lambda v: (v >= 6).astype(np.uint8))
    assert (block.x[block.place] == (x >= 6)).all() and block.y[block.place].tolist() == [0, 0, 0, 1, 1, 1]
    assert len(block.y) == 2 and (block.row == row).all()


def test_normal_scores_of_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    found = [r[0] for r in df.select(normal_score([1.0, 2.0, 3.0])("v")).collect()]
    assert found[1] == found[2] == 0.0 and found[0] == -found[3] < -5 and found[4:] == [None, None]
