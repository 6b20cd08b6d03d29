"""Registry of queries and helpers for binding them to a data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import quoted

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, since the two engines add in different order."""
    return df.select(*[
        F.round(quoted(c), digits).alias(c) if t in ("double", "float") else quoted(c) for c, t in df.dtypes
    ])
