from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyframe.operators import features


def values(df, name):
    return [r[name] for r in df.collect()]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5), (10.0, 5), (None, 5)], "x double, flat int")
    x = np.array([1.0, 2, 3, 10])
    expected = {
        "standard": (x - x.mean()) / x.std(), "minmax": (x - 1) / 9,
        "robust": (x - 2.5) / (np.quantile(x, 0.75) - np.quantile(x, 0.25)),
    }
    for mode, want in expected.items():
        out = features.scale(df, ["x", "flat"], mode)
        assert values(out, "x")[:4] == pytest.approx(want.tolist()) and values(out, "x")[4] is None
        assert set(values(out, "flat")) == {0.0}
    with pytest.raises(ValueError):
        features.make_scaler("nope", ["x"], ["x"])


def test_quantile_scaler_edges_ties_and_missing(spark):
    data = [0.0] * 6 + [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v,) for v in data] + [(None,), (float("nan"),)], "x double")
    model = features.make_scaler("QUANTILE", ["x"], ["z"]).fit(df)
    out = values(model.transform(df), "z")
    assert out[0] == pytest.approx(-features.EDGE_SCORE) and out[9] == pytest.approx(features.EDGE_SCORE)
    assert out[10] is None and out[11] is None
    beyond = spark.createDataFrame([(-5.0,), (99.0,), (2.5,)], "x double")
    low, high, middle = values(model.transform(beyond), "z")
    assert (low, high) == pytest.approx((-features.EDGE_SCORE, features.EDGE_SCORE))
    # landmarks are the quantiles at i / 11 of the ten known values
    marks = np.quantile(data, np.linspace(0, 1, 12))
    share = (np.interp(2.5, marks, np.linspace(0, 1, 12)))
    assert middle == pytest.approx(NormalDist().inv_cdf(share))


def test_ties_get_the_centre_of_their_share(spark):
    data = [0.0, 1.0, 1.0, 1.0, 2.0]
    out = features.scale(spark.createDataFrame([(v,) for v in data], "x double"), ["x"], "quantile")
    assert values(out, "x")[1] == pytest.approx(0.0)


def test_rare_values_share_a_column_and_unseen_ones_join_them(spark):
    rows = [("a",)] * 60 + [("b",)] * 39 + [("z",)]
    df = spark.createDataFrame(rows, "c string")
    model = features.RareOneHot(["c"], ["h"], 0.05).fit(df)
    assert model.names() == [["c_a", "c_b", "c_infrequent"]]
    new = spark.createDataFrame([("b",), ("new",), ("z",), (None,)], "c string")
    hot = model.transform(new).select(vector_to_array("h").alias("h"))
    assert values(hot, "h") == [[0, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 0]]
    exact = features.RareOneHot(["c"], ["h"], 0.01).fit(df)  # a share of exactly 1 % is frequent
    assert exact.names() == [["c_a", "c_b", "c_z"]]
    assert values(exact.transform(new).select(vector_to_array("h").alias("h")), "h")[1] == [0, 0, 0]


def test_preprocessor_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i), "ab"[i % 2] if i % 7 else None) for i in range(50)],
                               "id int, n double, c string")
    prep = features.build_preprocessor(["n"], ["c"], "quantile").fit(df)
    assert features.feature_names(prep) == ["n", "c_a", "c_b"]
    prep.write().overwrite().save(str(tmp_path / "prep"))
    again = PipelineModel.load(str(tmp_path / "prep"))
    a, b = (m.transform(df).select("id", vector_to_array("features").alias("f")).orderBy("id").collect() for m in (prep, again))
    assert a == b and len(a[0]["f"]) == 3
    names = [x["name"] for x in prep.transform(df).schema["features"].metadata["ml_attr"]["attrs"]["numeric"]]
    assert len(names) == 3
    assert df.join(prep.transform(df), "id").where(F.size(vector_to_array("features")) != 3).count() == 0


@pytest.mark.parametrize("mode", features.SCALER_MODES)
def test_the_joint_fit_equals_fitting_stage_by_stage(spark, mode):
    """Nulls (even and odd numbers of values), a column without values, ties in the mode, a mode made frequent by its nulls."""
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 3 == 0 else float(rng.integers(0, 9)) * 1.1, None if i == 4 else rng.normal(), None, 2 if i % 2 else None,
             None if i % 4 == 0 else "abcdefgh"[i % 8], None if i % 50 else "rare", None) for i in range(101)]
    df = spark.createDataFrame(rows, "id int, x double, y double, none double, flat int, c string, m string, n string")
    numeric, words = ["x", "y", "none", "flat"], ["c", "m", "n"]
    filled, scaled = [f"{c}__filled" for c in numeric], [f"{c}__scaled" for c in numeric]
    kept, hot = [f"{c}__filled" for c in words], [f"{c}__onehot" for c in words]
    apart = Pipeline(stages=[
        features.ColumnImputer(numeric, filled, "median"), features.make_scaler(mode, filled, scaled),
        features.ColumnImputer(words, kept, "mode"), features.RareOneHot(kept, hot, 0.1),
        VectorAssembler(inputCols=[*scaled, *hot], outputCol="features", handleInvalid="keep")]).fit(df)
    joint = features.build_preprocessor(numeric, words, mode, 0.1).fit(df)
    assert features.feature_names(joint) == features.feature_names(apart)
    for a, b in zip(joint.stages[:-1], apart.stages[:-1]):
        for p in a.params:
            got, want = a.getOrDefault(p), b.getOrDefault(p.name)
            if p.name in ("centres", "spreads"):
                assert got == pytest.approx(want)
            else:
                assert got == want, p.name


def test_the_joint_fit_takes_few_jobs(spark):
    """Their number doesn't grow with the columns."""
    def jobs(columns):
        df = spark.range(2000).select(*[(F.xxhash64("id", F.lit(i)) / 7).alias(f"x{i}") for i in range(columns)],
                                      *[F.pmod(F.col("id"), F.lit(9 + i)).cast("string").alias(f"w{i}") for i in range(columns)])
        group = f"joint-{columns}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            features.build_preprocessor([f"x{i}" for i in range(columns)], [f"w{i}" for i in range(columns)]).fit(df)
        finally:
            spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert 0 < jobs(8) <= jobs(2) + 2
