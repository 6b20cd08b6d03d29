import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import clean, groups, profile, quantiles
from tallyframe.operators.clean import with_target


def rows(df, *cols):
    return [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]


def test_shape_types_and_roles(spark, census):
    assert rows(profile.shape(census)) == [(6000, 14)]
    assert rows(profile.dtype_counts(census)) == [("bigint", 7), ("string", 7)]  # equal counts in key order
    roles = profile.columns_by_role(census, ("label",))
    assert "label" not in roles["categorical"] and "age" in roles["numeric"]
    assert profile.available(census, ["age", "absent"]) == ["age"]
    with pytest.raises(ValueError):
        profile.available(census, ["absent"])


def test_nulls_and_sentinels(spark):
    df = spark.createDataFrame([("?", None, 1), (" ?", "x", None), ("?", None, None)], "a string, `b's` string, c int")
    assert rows(profile.null_counts(df)) == [("b's", 2), ("c", 2)]
    # the padded sentinel does not match
    assert rows(profile.sentinel_counts(df)) == [("a", 2, pytest.approx(200 / 3))]
    assert rows(profile.sentinel_counts(df.select("c"))) == []


def test_value_counts_divide_by_all_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert sorted(rows(profile.value_counts(df, ["v"]))) == [("v", "a", 2, 50.0), ("v", "b", 1, 25.0)]
    ties = spark.createDataFrame([(c,) for c in "zyxwvu"], "v string")
    assert sorted(r[1] for r in rows(profile.value_counts(ties, ["v"], top=5))) == list("uvwxy")
    assert rows(profile.distinct_counts(df, ["v"])) == [("v", 2)]
    assert rows(profile.distinct_counts(df, ["v"], approx=True)) == [("v", 2)]


def test_class_balance_without_class_one(spark):
    df = spark.createDataFrame([(0,), (0,)], "target int")
    assert rows(profile.class_balance(df)) == [(0, 2, 100.0, None)]


def test_quantiles_interpolate_and_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert quantiles.quantile_values(df, ["x"], [0.25, 0.5])["x"] == [1.75, 2.5]
    empty = df.where("x > 99 AND NOT isnan(x)")
    assert quantiles.quantile_values(empty, ["x"], [0.5])["x"] == [None]
    approximate = quantiles.quantiles(spark.range(1, 102).withColumn("x", F.col("id").cast("double")), ["x"], [0.5], exact=False)
    assert rows(approximate) == [("x", 0.5, 51.0)]


@pytest.mark.parametrize("cells, fetch", [(1 << 10, 0), (1 << 14, 100), (quantiles.PASS_CELLS, quantiles.FETCH_ROWS)])
def test_quantiles_by_passes_match_numpy(spark, cells, fetch):
    values = np.concatenate([np.full(700, 3.25), np.random.default_rng(1).normal(size=1301), [-np.inf, np.inf, -0.0, 0.0, 1e-310, -1e300]])
    df = spark.createDataFrame([(float(v), i % 3 / 10) for i, v in enumerate(values)], "x double, few double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for many in (probs, np.linspace(0, 1, 101).tolist()):
        found = quantiles.quantile_values(df, ["x", "few"], many, pass_cells=cells, fetch_rows=fetch)
        assert np.allclose(found["x"][1:-1], np.quantile(values, many)[1:-1]) and found["x"][0] == -np.inf and found["x"][-1] == np.inf
        assert set(found["few"]) <= {0.0, 0.1, 0.2}  # ties come out as they are
    grouped = quantiles.grouped_quantiles(df, [], ["x", "few"], probs, window_rows=fetch)
    rows = {(r["column"], r["prob"]): r["value"] for r in grouped.collect()}
    assert np.allclose([rows["x", p] for p in probs[1:-1]], np.quantile(values, probs)[1:-1])
    assert {rows["few", p] for p in probs} <= {0.0, 0.1, 0.2}


def test_tied_values_stay_on_their_side_of_a_cut(spark):
    """0.02 and 0.07 are no sums of halves: an interpolation between equal values must give that very value."""
    df = spark.createDataFrame([(v,) for v in [0.02] * 40 + [0.07] * 57 + [0.1] * 3], "x double")
    found = quantiles.quantile_values(df, ["x"], [i / 10 for i in range(11)])["x"]
    assert found == [0.02] * 4 + [found[4]] + [0.07] * 5 + [0.1] and 0.02 <= found[4] <= 0.07
    bands = {(r["x"], r["band"]) for r in groups.quartile_bands(df, "x").collect()}
    assert bands == {(0.02, "low"), (0.07, "high"), (0.1, "high")}
    capped = clean.cap_extreme_with_mode(df, ["x"], 0.97)
    assert [r["x"] for r in capped.collect()].count(0.07) == 57 + (3 if quantiles.quantile_values(df, ["x"], [0.97])["x"][0] < 0.1 else 0)
    out = profile.iqr_outliers(df, ["x"], k=0.0).first()
    assert (out["lower_bound"], out["upper_bound"], out["cnt"]) == (0.02, 0.07, 3)


def test_group_median_of_a_dominant_key(spark):
    rng = np.random.default_rng(2)
    data = [("hot", float(v)) for v in rng.normal(size=900)] + [(k, float(v)) for k in "abc" for v in rng.normal(size=7)]
    df = spark.createDataFrame([*data, (None, 1.0)], "k string, x double")
    expected = {k: np.median([v for kk, v in data if kk == k]) for k in ("hot", "a", "b", "c")}
    found = quantiles.grouped_quantiles(df.where("k IS NOT NULL"), ["k"], ["x"], [0.5])
    assert {r["k"]: r["value"] for r in found.collect()} == pytest.approx(expected)
    table = groups.group_profile(df, "k", {"x": ["mean", "median", "count"]}, digits=None)
    assert {r["k"]: r["x_median"] for r in table.collect()} == pytest.approx(expected)


def test_describe_and_outliers(spark):
    df = spark.createDataFrame([(float(v), 7) for v in [1, 2, 3, 4, 100]], "x double, flat int")
    x, flat = sorted(rows(profile.describe_numeric(df, ["x", "flat"])), reverse=True)
    assert x == ("x", 5, 22.0, pytest.approx(np.std([1, 2, 3, 4, 100], ddof=1)), 1.0, 2.0, 3.0, 4.0, 100.0)
    assert flat[3] == 0.0
    out = {r["column"]: r for r in profile.iqr_outliers(df, ["x", "flat"]).collect()}
    assert (out["x"]["lower_bound"], out["x"]["upper_bound"], out["x"]["cnt"], out["x"]["flagged"]) == (-1, 7, 1, True)
    assert (out["flat"]["cnt"], out["flat"]["flagged"]) == (0, False)  # strict bounds
    single = profile.describe_numeric(df.limit(1), ["x"]).first()
    assert single["std"] is None


def test_crosstab_and_histogram(spark, census):
    df = with_target(census)
    shares = profile.crosstab_rate(df, "race").collect()
    assert all(abs(r["share_0"] + r["share_1"] - 1) < 1e-12 for r in shares)
    hist = profile.density_histogram(df, ["age", "year"], bins=50)
    total = hist.groupBy("column", "by").agg(
        F.sum(F.col("density") * (F.col("upper_edge") - F.col("lower_edge"))).alias("area"), F.count("*").alias("bins"))
    for r in total.collect():
        assert r["bins"] == 50 and abs(r["area"] - 1) < 1e-9
    ages = np.array([r["age"] for r in df.where("target = 1").select("age").collect()])
    expected, edges = np.histogram(ages, bins=50, density=True)
    got = hist.where("column = 'age' AND by = 1").orderBy("bin").collect()
    assert np.allclose([r["density"] for r in got], expected) and np.allclose([r["lower_edge"] for r in got], edges[:-1])
    flat = hist.where("column = 'year' AND cnt > 0").collect()
    assert {r["bin"] for r in flat} == {25}


def test_histogram_and_shares_of_many_classes(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("target"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("cat"))
    out = profile.density_histogram(df, ["x"], bins=4)
    assert out.count() == 6000 and out.agg(F.sum("cnt")).first()[0] == 6000
    shares = profile.crosstab_rate(df.withColumn("target", F.col("x") % 3), "cat").collect()
    assert all(abs(sum(r[f"share_{c}"] for c in ("0.0", "1.0", "2.0")) - 1) < 1e-12 for r in shares)


def test_infinite_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("inf"),)], "x double")
    row = profile.iqr_outliers(df, ["x"]).first()
    assert row["upper_bound"] is None or row["upper_bound"] != row["upper_bound"] or row["upper_bound"] == float("inf")


def test_quantiles_of_small_groups_take_one_pass_without_python(spark, capsys):
    rows = [(i % 3 if i % 10 else None, [None, -0.0, 0.0, float("nan"), float("inf")][i % 5] if i % 4 == 0 else float(i * 7 % 31) - 15) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.grouped_quantiles(df, ["g"], ["x"], probs)
    found.explain()
    assert "Python" not in capsys.readouterr().out
    by_cells = quantiles.grouped_quantiles(df, ["g"], ["x"], probs, window_rows=5)
    as_text = lambda d: sorted((r["g"], r["column"], r["prob"], repr(r["value"])) for r in d.collect())
    assert as_text(found) == as_text(by_cells) and len(as_text(found)) == 15
