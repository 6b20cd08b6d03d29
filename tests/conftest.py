import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.session import RECOMMENDED_SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map=RECOMMENDED_SETTINGS)
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def census(spark):
    """Rows shaped like the raw table: padded text, sentinels, a null label, a rare value, long money tails."""
    def pick(salt, *words):
        return F.element_at(F.array(*[F.lit(w) for w in words]),
                            (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    h = F.pmod(F.xxhash64("id", F.lit("money")), F.lit(1000))
    weeks = F.pmod(F.xxhash64("id", F.lit("weeks")), F.lit(53))
    age = F.pmod(F.xxhash64("id", F.lit("age")), F.lit(80))
    rich = (weeks > 45) & (age > 35) & (F.pmod(F.xxhash64("id", F.lit("rich")), F.lit(3)) == 0)
    occupation = F.when(F.col("id") < 50, " Armed Forces").otherwise(
        pick("occ", " Sales", " Professional specialty", " Other service", " Not in universe"))
    return spark.range(6000).select(
        F.col("id"), age.alias("age"),
        pick("cls", " Private", " Private", " Self-employed", " ?").alias("class of worker"),
        F.when(F.col("id") % 400 == 0, " Doctorate").otherwise(
            pick("edu", " High school graduate", " Some college", " Bachelors degree(BA AB BS)")).alias("education"),
        pick("mar", " Never married", " Married", "?").alias("marital stat"),
        occupation.alias("major occupation code"),
        pick("race", " White", " Black").alias("race"), pick("sex", " Male", " Female").alias("sex"),
        F.when(h > 900, h * 10).otherwise(0).cast("long").alias("capital gains"),
        F.when(h < 50, h + 1000).otherwise(0).cast("long").alias("capital losses"),
        weeks.alias("weeks worked in year"),
        F.pmod(F.xxhash64("id", F.lit("emp")), F.lit(7)).alias("num persons worked for employer"),
        F.lit(95).cast("long").alias("year"),
        F.when(F.col("id") == 17, F.lit(None)).when(rich, " 50000+.").otherwise(" - 50000.").alias("label"),
    ).persist()
