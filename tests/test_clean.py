from pyspark.sql import functions as F

from tallyframe.functions.expressions import LOW_LABEL_PATTERN_ONE_SPACE, ellipsize, title_label
from tallyframe.operators import clean


def col(df, name):
    return [r[name] for r in df.collect()]


def test_label_patterns_and_null_label(spark):
    df = spark.createDataFrame([(" - 50000.",), ("-50000",), ("50000+.",), (None,)], "label string")
    assert col(clean.with_target(df), "target") == [0, 0, 1, 1]
    assert col(clean.with_target(df, pattern=LOW_LABEL_PATTERN_ONE_SPACE), "target") == [0, 1, 1, 1]


def test_sentinel_before_trimming(spark):
    df = spark.createDataFrame([("?", 1), (" ?", 2), (" a ", 3), (None, 4)], "v string, n int")
    nulled = clean.sentinel_to_null(df)
    assert col(nulled, "v") == [None, " ?", " a ", None]
    # with the null token, missing text becomes a category of its own and the padded sentinel stays
    assert col(clean.normalize_strings(nulled, null_token="nan"), "v") == ["nan", "?", "a", "nan"]
    assert col(clean.normalize_strings(df, sentinel="?"), "v") == [None, None, "a", None]


def test_select_coerce_fill(spark):
    df = spark.createDataFrame([("12", None, 0), ("x", 5, 1)], "a string, m int, target int")
    assert clean.select_features(df, ["m", "absent"]).columns == ["m", "target"]
    assert col(clean.coerce_numeric(df, ["a", "m"]), "a") == [12.0, None]
    assert clean.coerce_numeric(df, ["m"]).schema["m"] == df.schema["m"]
    assert col(clean.fill_nulls(df, {"m": 0, "absent": 1}), "m") == [0, 5]


def test_modes_take_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(3, "b", 1.5), (1, "a", None), (3, "a", 1.5), (1, "b", 2.5), (None, None, 2.5)],
                               "n int, s string, x double")
    assert clean.top_value(df, ["n", "s", "x"]) == {"n": 1, "s": "a", "x": 1.5}
    assert clean.mode_or_median(df, "n", F.col("n") > 50) == 2.0
    assert clean.top_value(df.where("n > 50"), ["n"]) == {"n": None}


def test_invalid_values_take_the_mode(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (7,), (5,), (5,)], "age long")
    assert col(clean.replace_invalid_with_mode(df, "age"), "age") == [5, 5, 5, 7, 5, 5]
    zeros = spark.createDataFrame([(0,), (0,)], "age long")
    assert col(clean.replace_invalid_with_mode(zeros, "age"), "age") == [0, 0]


def test_extremes_take_the_mode_and_the_cutoff_stays(spark):
    df = spark.range(1, 201).select(F.when(F.col("id") <= 150, 4).otherwise(F.col("id")).alias("gain"), F.lit(None).cast("long").alias("none"))
    out = clean.cap_extreme_with_mode(df, ["gain", "none"])
    assert out.count() == 200
    assert out.agg(F.max("gain")).first()[0] == 198  # q99 = 198.01
    report = {r["column"]: r for r in clean.extreme_report(df, ["gain", "none"]).collect()}
    assert (round(report["gain"]["cutoff"], 6), report["gain"]["mode"], report["gain"]["replaced"]) == (198.01, 4.0, 2)
    assert report["none"]["replaced"] == 0
    flat = spark.createDataFrame([(1,)] * 5, "gain long")
    assert clean.extreme_report(flat, ["gain"]).first()["replaced"] == 0  # strictly above only


def test_text_helpers(spark):
    df = spark.createDataFrame([("Professional specialty",), ("Sales",)], "o string").select(
        ellipsize(F.col("o"), 20).alias("a"), ellipsize(F.col("o"), 12, always=True).alias("b"),
        title_label(F.lit("avg_weeks_worked")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [
        ("Professional special...", "Professional...", "Avg Weeks Worked"), ("Sales", "Sales...", "Avg Weeks Worked")]
