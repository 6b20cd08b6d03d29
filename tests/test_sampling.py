import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import sampling


def in_order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), k))


def labelled(spark, n=3000):
    return spark.range(n).select("id", F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("target"))


def test_downsample_is_exact_and_repeatable(spark):
    df = labelled(spark)
    out = sampling.downsample(df, "target", "id")
    zeros = [r["id"] for r in out.where("target = 0").collect()]
    ones = out.where("target = 1").count()
    assert ones == 429 and len(zeros) == 429
    assert sorted(zeros) == sorted(in_order([i for i in range(3000) if i % 7])[:429])


def test_class_one_is_never_reduced(spark):
    df = labelled(spark, 700).withColumn("target", 1 - F.col("target"))
    out = sampling.downsample(df, "target", "id")
    assert out.count() == 700
    only = df.where("target = 1")
    assert sampling.downsample(only, "target", "id").count() == only.count()


def test_deep_prefixes_give_the_same_sample(spark, monkeypatch):
    df = labelled(spark)
    expected = sorted(r["id"] for r in sampling.downsample(df, "target", "id").collect())
    monkeypatch.setattr(sampling, "PREFIX_ROWS", 1)
    assert sorted(r["id"] for r in sampling.downsample(df, "target", "id").collect()) == expected


def test_split_is_disjoint_complete_and_stratified(spark):
    df = labelled(spark, 1001)
    train, test = sampling.stratified_split(df, "target", "id")
    a, b = ({r["id"] for r in part.collect()} for part in (train, test))
    assert not a & b and len(a | b) == 1001 and len(b) == math.ceil(0.3 * 1001)
    assert test.where("target = 1").count() == 43  # 143 * 301 / 1001 = 43.0


def quotas(spark, sizes):
    rows = sampling.split_sizes(spark.createDataFrame(list(sizes.items()), "t int, n long"), 0.3).collect()
    return {r["t"]: r["quota"] for r in rows}


def test_split_sizes_share_the_remainder(spark):
    assert quotas(spark, {0: 5, 1: 5}) == {0: 2, 1: 1}
    assert quotas(spark, {0: 10, 1: 10}) == {0: 3, 1: 3}
    assert sum(quotas(spark, {0: 348, 1: 51}).values()) == 120


def test_any_number_of_classes(spark):
    df = spark.range(6000).withColumn("target", F.when(F.col("id") % 1500 > 0, F.col("id") % 1500))
    train, test = sampling.stratified_split(df, "target", "id")
    got = {r["target"]: r["count"] for r in test.groupBy("target").count().collect()}
    assert sum(got.values()) == 1800 and set(got.values()) == {1, 2} and None in got
    assert train.count() == 4200 and train.intersect(test).count() == 0


def test_other_classes_and_repeated_keys_are_errors(spark):
    three = spark.range(30).withColumn("target", F.col("id") % 3)
    with pytest.raises(ValueError):
        sampling.downsample(three, "target", "id")
    twice = spark.range(40).select((F.col("id") % 4).alias("id"), F.when(F.col("id") < 5, 1).otherwise(0).alias("target"))
    with pytest.raises(Exception, match="not unique"):
        sampling.downsample(twice, "target", "id").collect()


def test_split_plan_has_no_shuffle(spark):
    df = labelled(spark)
    train, _ = sampling.stratified_split(df, "target", "id")
    assert "hashpartitioning" not in train._jdf.queryExecution().executedPlan().toString()


def test_shuffle(spark):
    df = spark.range(100)
    assert [r["id"] for r in sampling.shuffle(df, "id").collect()] == in_order(range(100))
