import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.tails import chi2_tail, f_tail
from tallyframe.operators import scores


def test_label_codes_follow_sorted_values(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (3, "a", "x"), (4, "Z", None)], "id int, s string, t string")
    expected = [(1, 3, 1), (2, 0, 2), (3, 2, 1), (4, 1, 0)]  # Unknown < Z < a < b
    assert sorted(tuple(r) for r in scores.label_encode(df, ["s", "t"]).collect()) == expected
    monkeypatch.setattr(scores, "MAX_LITERAL_VALUES", 3)  # one column by literal, one by broadcast join
    assert sorted(tuple(r) for r in scores.label_encode(df, ["s", "t"]).collect()) == expected
    monkeypatch.setattr(scores, "SMALL_ROWS", 0)
    monkeypatch.setattr("tallyframe.operators.groups.is_small", lambda df: False)
    assert sorted(tuple(r) for r in scores.label_encode(df, ["s", "t"]).collect()) == expected


def test_correlation_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 4)) + 1e6
    data[:, 1] += 0.8 * (data[:, 0] - 1e6)
    missing = rng.random(size=data.shape) < 0.1
    missing[:, 0] = False
    rows = [tuple(None if m else float(v) for v, m in zip(r, g)) + (5.1,) for r, g in zip(data, missing)]
    cols = ["a", "b's", "c", "d", "flat"]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    expected = {}
    for i in range(4):
        for j in range(i + 1, 4):
            known = ~(missing[:, i] | missing[:, j])
            expected[i, j] = np.corrcoef(data[known, i], data[known, j])[0, 1]
    for max_pairs in (100, 0):
        found = {(r["i"], r["j"]): r["corr"] for r in scores.correlation_pairs(df, cols, max_pairs).collect()}
        assert len(found) == 10
        for pair, value in found.items():
            if 4 in pair:
                assert value is None
            else:
                assert value == pytest.approx(expected[pair], abs=1e-9)
    matrix = scores.correlation_matrix(df, cols)
    assert matrix.count() == 25
    assert matrix.where("feature1 = 'flat' AND feature2 = 'flat'").first()["corr"] is None
    # undefined values sort last
    best = scores.target_correlation(df, ["b's", "flat", "c"], "a")
    assert [r["feature"] for r in best.collect()] == ["b's", "c", "flat"]
    assert [tuple(r)[:2] for r in scores.high_corr_pairs(df, cols, 0.6).collect()] == [("a", "b's")]
    lower = scores.corr_lower_triangle(df, cols)
    assert lower.count() == 10 and lower.where("row = 'flat' AND col = 'a'").count() == 1


def test_chi2_compares_class_sums(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (6, 1, 0)], "x int, target int, zero int")
    out = {r["feature"]: r for r in scores.chi2_scores(df, ["x", "zero"]).collect()}
    assert out["x"]["chi2_score"] == pytest.approx((3 - 6) ** 2 / 6 + (9 - 6) ** 2 / 6)
    assert out["x"]["chi2_pval"] == pytest.approx(math.erfc(math.sqrt(3 / 2)))
    assert out["zero"]["chi2_score"] is None
    with pytest.raises(Exception, match="negative"):
        scores.chi2_scores(df.withColumn("x", -F.col("x")), ["x"]).collect()


def test_f_score(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0), (4.0, 1), (6.0, 1)], "x double, target int")
    row = scores.f_scores(df, ["x"]).first()
    assert row["f_score"] == pytest.approx(10.8 / (4 / 3))  # between 10.8 on 1, within 4 on 3
    assert row["f_pval"] == pytest.approx(0.0654, abs=2e-4)


def test_tail_probabilities():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_tail(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25)
    assert f_tail(4.0, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0))
    assert f_tail(1.0, 7, 7) == pytest.approx(0.5)
    # on one and very many degrees of freedom F is the square of a normal variable
    assert f_tail(3.841458820694124, 1, 1e7) == pytest.approx(0.05, rel=1e-5)


def test_mutual_information(spark):
    df = spark.createDataFrame([(0, 0, 1.5), (0, 0, 2.5), (1, 1, 3.5), (1, 1, 4.5)], "same int, target int, x double")
    df = df.withColumn("flat", F.lit(3))
    out = {r["feature"]: r["mutual_info"] for r in scores.mutual_info(df, ["same", "flat", "x"]).collect()}
    assert out["same"] == pytest.approx(math.log(2)) and out["flat"] == pytest.approx(0) and out["x"] == pytest.approx(math.log(2))
    binned = scores.mutual_info(df, ["x"], bins=2).first()["mutual_info"]
    assert binned == pytest.approx(math.log(2))


def test_udfs_need_no_installed_package(tmp_path):
    """Executors get the code of the UDFs with the tasks: the package is only on the driver's path here."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tallyframe.operators import features, scores
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (7.0, 1)], "x double, target int")
print(len(scores.f_scores(df, ["x"]).collect()), len(scores.chi2_scores(df, ["x"]).collect()),
      features.scale(df, ["x"], "quantile").count(), "done")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "1 1 4 done" in run.stdout, run.stderr[-2000:]


def test_mutual_info_counts_every_class(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3).alias("target"))
    assert abs(scores.mutual_info(df, ["x"]).first()["mutual_info"] - np.log(3)) < 1e-12


def test_nearest_mutual_info_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    x = {"signal": y + rng.normal(0, 0.5, 300), "noise": rng.normal(size=300)}
    df = spark.createDataFrame([(i, int(t), float(a), float(b)) for i, (t, a, b) in enumerate(zip(y, x["signal"], x["noise"]))],
                               "id int, target int, signal double, noise double")

    def psi(n):
        return sum(1 / i for i in range(1, n)) - 0.5772156649015329

    def brute(v):
        found = []
        for i in range(len(v)):
            radius = np.sort(np.abs(v[y == y[i]] - v[i]))[3]
            found.append(psi(3) - psi(int((y == y[i]).sum())) - psi(int((np.abs(v - v[i]) < radius).sum())))
        return max(0.0, psi(len(v)) + np.mean(found))

    for rows in (50, 10 ** 6):
        got = {r["feature"]: r["mutual_info"] for r in scores.nearest_mutual_info(df, ["signal", "noise"], "id", range_rows=rows).collect()}
        assert all(abs(got[c] - brute(x[c])) < 1e-9 for c in x) and got["noise"] < 0.1


def test_score_tables_are_complete(spark):
    df = spark.range(50).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(18)], (F.col("id") % 2).alias("target"))
    cols = [f"c{i}" for i in range(18)]
    for table in (scores.chi2_scores, scores.f_scores, scores.mutual_info, scores.target_correlation):
        assert table(df, cols).count() == 18


def test_correlations_of_large_values_with_small_deviations(spark):
    """Mean 1e9 and deviation 1, constants, nulls in pairs, values that are constant where the other one is known."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000)
    pdf = pd.DataFrame({"a": 1e9 + a, "b": 1e9 + 0.5 * a + rng.normal(size=4000), "flat": 0.1, "c": rng.normal(size=4000)})
    pdf.loc[::3, "c"] = None
    pdf["half"] = np.where(pdf["c"].isna(), rng.normal(size=4000), 7.3)
    expected = pdf.corr()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "a double, b double, flat double, c double, half double").repartition(7)
    for max_pairs in (100, 0):
        found = {(r["feature1"], r["feature2"]): r["corr"] for r in scores.correlation_pairs(df, list(pdf.columns), max_pairs).collect()}
        assert len(found) == 10
        for (f, g), corr in found.items():
            if "flat" in (f, g) or (f, g) == ("c", "half"):
                assert corr is None
            else:
                assert corr == pytest.approx(expected.loc[f, g], abs=1e-7)
