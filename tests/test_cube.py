import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profile, scores
from tallyframe.operators.cube import CountCube


@pytest.fixture(scope="module")
def words(spark):
    """A value that fills most rows, nulls in values and classes, a column without values, a name with a dot."""
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 10 < 8, "hot").when(i % 10 == 8, F.concat(F.lit("v"), i % 7)).alias("a.b"),
        F.when(i % 3 > 0, F.concat(F.lit("w"), F.pmod(F.xxhash64(i), F.lit(5)))).alias("c"),
        F.lit(None).cast("string").alias("none"), F.when(i % 11 > 0, (i % 2).cast("int")).alias("target"))


def same(a, b):
    def rows(df):
        return sorted(tuple((c, round(r[c], 9) if isinstance(r[c], float) else r[c]) for c in sorted(df.columns)) for r in df.collect())
    return str(rows(a)) == str(rows(b)) and sorted(a.dtypes) == sorted(b.dtypes)


def test_the_cube_answers_like_the_operators(spark, words):
    cols = ["a.b", "c", "none"]
    cube = CountCube(words, cols)
    assert same(cube.value_counts(top=2), profile.value_counts(words, cols, top=2))
    assert same(cube.value_counts(), profile.value_counts(words, cols))
    assert same(cube.distinct_counts(), profile.distinct_counts(words, cols))
    assert {r["target"]: r["cnt"] for r in cube.class_balance().collect()} == {
        r["target"]: r["cnt"] for r in profile.class_balance(words).collect()}
    assert same(cube.crosstab_rate("c"), profile.crosstab_rate(words, "c"))
    coded = {r["feature"]: r["mutual_info"] for r in scores.mutual_info(scores.label_encode(words, cols), cols).collect()}
    assert {r["feature"]: r["mutual_info"] for r in cube.mutual_info().collect()} == pytest.approx(coded)


def test_an_empty_table(spark, words):
    cube = CountCube(words.limit(0), ["c"])
    assert cube.value_counts(top=3).count() == 0 and cube.distinct_counts().first()["n_distinct"] == 0
    assert cube.class_balance().count() == 0 and cube.mutual_info().count() == 0


def test_the_table_is_scanned_once(spark, words):
    """All tables of the cube come from the stored counts, not from the rows."""
    cube = CountCube(words, ["a.b", "c"])
    for table in (cube.value_counts(5), cube.distinct_counts(), cube.class_balance(), cube.crosstab_rate("c"), cube.mutual_info()):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan
