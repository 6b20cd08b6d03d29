"""Table readers and writers."""

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.expressions import strict_number
from tallyframe.session import quoted

# The white space a line is stripped of, and the texts a headed CSV uses for "missing".
BLANKS = " \t\n\r\x0b\x0c"
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _lines(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{what} not found: {path}") from e
        raise
    return lines.select(F.btrim("value", F.lit(BLANKS)).alias("line")).where("line <> ''")


def read_column_names(spark: SparkSession, path: str) -> list[str]:
    """Column names, one per line, in file order."""
    numbered = _lines(spark, path, "column list").withColumn("n", F.monotonically_increasing_id())
    return [r["line"] for r in numbered.orderBy("n").collect()]


def _typed(text, kind: str):
    """Text as the wanted type, null where it does not fit; real numbers by the strict rule."""
    return strict_number(text).cast(kind) if kind.lower() in ("double", "float") else text.try_cast(kind)


def read_headerless(
    spark: SparkSession, path: str, names: list[str], types: dict[str, str] | None = None
) -> DataFrame:
    """Plain comma-separated lines without header or quoting.

    Lines are stripped and blank lines skipped; fields keep their inner blanks. A line with another number of
    fields fills the columns from the left and is kept whole in `_ragged`. `types` casts columns, and a text
    that does not fit becomes null.
    """
    fields = F.split("line", ",", -1)
    ragged = F.when(F.size(fields) != len(names), F.col("line"))

    def column(i, name):
        value = F.get(fields, F.lit(i))
        wanted = (types or {}).get(name)
        return (value if wanted is None else _typed(value, wanted)).alias(name)

    rows = _lines(spark, path, "data file")
    return rows.select(*[column(i, n) for i, n in enumerate(names)], ragged.alias("_ragged"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write Parquet, or CSV with a header line."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(fmt).save(path)


def _with_header(batches, header: str):
    first = True
    for batch in batches:
        if first and batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([header])], names=["line"])
            first = False
        yield batch


def convert_headerless(spark: SparkSession, columns_path: str, data_path: str, out_path: str, fmt: str = "csv") -> DataFrame:
    """Give a headerless file its header; returns one row with `rows`, `columns` and `ragged_rows`.

    No field is lost: CSV lines are written as they are, other formats keep a ragged line in `_ragged`.
    """
    names = read_column_names(spark, columns_path)
    rows = read_headerless(spark, data_path, names)
    if fmt == "csv":
        lines = _lines(spark, data_path, "data file").select("line")
        header = ",".join(f'"{n.replace(chr(34), chr(34) * 2)}"' if set(n) & set(',"') else n for n in names)
        # Lines pass on unchanged, surplus fields included; every part file starts with the header.
        lines.mapInArrow(lambda batches: _with_header(batches, header), "line string").write.mode("overwrite").text(out_path)
    else:
        write_table(rows, out_path, fmt)
    return rows.agg(
        F.count("*").alias("rows"), F.lit(len(names)).cast("long").alias("columns"),
        F.count("_ragged").alias("ragged_rows"),
    )


def infer_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast text columns whose every known value is a whole number to LONG, or a number to DOUBLE."""
    checks = df.agg(*[
        F.struct(F.count(quoted(c)).alias("n"), F.count(quoted(c).try_cast("long")).alias("whole"),
                 F.count(strict_number(quoted(c))).alias("real")).alias(f"c{i}")
        for i, c in enumerate(cols)
    ]).first()

    def typed(c, seen):
        if seen["whole"] == seen["n"]:
            return quoted(c).try_cast("long" if seen["n"] else "double")
        return strict_number(quoted(c)) if seen["real"] == seen["n"] else quoted(c)

    return df.withColumns({c: typed(c, checks[f"c{i}"]) for i, c in enumerate(cols)})


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None, null_tokens: tuple = NULL_TOKENS
) -> DataFrame:
    """Read a headed CSV (or Parquet); null tokens become nulls and types are inferred unless given."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True).option("escape", '"')
    text = reader.csv(path)
    text = text.select(*[
        F.when(~quoted(c).isin(*null_tokens), quoted(c)).alias(c) for c in text.columns
    ])
    if schema is None:
        return infer_types(text, text.columns)
    wanted = spark.createDataFrame([], schema).dtypes
    return text.select(*[_typed(quoted(c), t).alias(c) for c, t in wanted])


def write_segments(df: DataFrame, path: str, key: str, rate: str = "high_income_rate") -> None:
    """Write the group table twice as CSV: `by_key` with the cluster, `ranked` by rate."""
    write_table(df.orderBy(quoted(key)), f"{path}/by_key", "csv")
    write_table(df.orderBy(quoted(rate).desc_nulls_last(), quoted(key)), f"{path}/ranked", "csv")
