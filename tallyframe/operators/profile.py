"""Table and column profiles. Each operator aggregates all its columns in one pass."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.expressions import SENTINEL, double_text, number, numbers, percentage, sql_text
from tallyframe.operators.quantiles import quantile_values
from tallyframe.session import checkpointed, is_small, quoted


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of the wanted columns that exist, in the wanted order; an error if none does."""
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError(f"none of the wanted columns exists: {wanted}")
    return found


def columns_by_role(df: DataFrame, exclude: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Column names split into `categorical` (strings) and `numeric`."""
    fields = [f for f in df.schema.fields if f.name not in exclude]
    return {
        "categorical": [f.name for f in fields if isinstance(f.dataType, T.StringType)],
        "numeric": [f.name for f in fields if isinstance(f.dataType, T.NumericType)],
    }


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


def dtype_counts(df: DataFrame) -> DataFrame:
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    return types.groupBy("dtype").agg(F.count("*").alias("columns")).orderBy(F.desc("columns"), "dtype")


def _per_column(df: DataFrame, cols: list[str], out: str, expression) -> DataFrame:
    """One aggregate per column over the whole table, turned into one row per column."""
    wide = df.agg(*[expression(c).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias(out)) for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, most nulls first: `column`, `nulls`."""
    counts = _per_column(df, df.columns, "nulls", lambda c: F.count_if(quoted(c).isNull()))
    return counts.where("nulls > 0").orderBy(F.desc("nulls"), "column")


def sentinel_counts(df: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """String columns that hold the sentinel: `column`, `cnt`, `pct` of all rows."""
    text = columns_by_role(df)["categorical"]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, cnt long, pct double")
    counts = _per_column(
        df, text, "found",
        lambda c: F.struct(F.count_if(quoted(c) == sentinel).alias("cnt"), F.count("*").alias("n")),
    )
    return (
        counts.select("column", "found.cnt", percentage(F.col("found.cnt"), F.col("found.n")).alias("pct"))
        .where("cnt > 0").orderBy(F.desc("cnt"), "column")
    )


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    text = df.select(*[quoted(c).cast("string").alias(c) for c in cols])
    return text.unpivot([], [quoted(c) for c in cols], "column", "value").where("value IS NOT NULL")


def value_counts(df: DataFrame, cols: list[str], top: int | None = None) -> DataFrame:
    """Counts of the non-null values with their share of all rows: `column`, `value`, `cnt`, `pct`."""
    counts = _long_values(df, cols).groupBy("column", "value").agg(F.count("*").alias("cnt"))
    return with_shares(counts, df.agg(F.count("*").alias("n")), top)


def with_shares(counts: DataFrame, rows: DataFrame, top: int | None = None) -> DataFrame:
    """The counts, or the `top` ones of every column, with their share of all rows (`rows`: one row, one number)."""
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("cnt"), "value"))
        counts = counts.withColumn("position", rank).where(F.col("position") <= top).drop("position")
    return counts.withColumn("pct", percentage(F.col("cnt"), rows.scalar()))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column: `column`, `n_distinct`."""
    if approx:
        return _per_column(df, cols, "n_distinct", lambda c: F.approx_count_distinct(quoted(c)))
    return _per_column(df, cols, "n_distinct", lambda c: F.count_distinct(quoted(c)))


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    """`target`, `cnt`, `pct` of all rows and the class 0 : class 1 ratio (null without class 1)."""
    return balance_of(df.groupBy(quoted(target).alias("target")).agg(F.count("*").alias("cnt")))


def balance_of(counts: DataFrame) -> DataFrame:
    """The balance from the counts per class: `target`, `cnt`."""
    # the totals come from the same class counts, so the table is read once
    totals = counts.agg(F.expr(
        "struct(sum(cnt) AS n, sum(cnt) FILTER (WHERE target = 0) AS n0, sum(cnt) FILTER (WHERE target = 1) AS n1) AS s"
    )).scalar()
    return counts.select(
        "target", "cnt",
        percentage(F.col("cnt"), totals["n"]).alias("pct"),
        F.try_divide(F.coalesce(totals["n0"], F.lit(0)).cast("double"), totals["n1"].cast("double")).alias("imbalance_ratio"),
    )


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    moments = numbers(df, cols).agg(*[
        F.expr(f"struct(count(x{i}) AS count, avg(x{i}) AS mean, stddev_samp(x{i}) AS std, min(x{i}) AS min, "
               f"max(x{i}) AS max) AS s{i}") for i in range(len(cols))
    ]).first()
    quartiles = quantile_values(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, *[moments[f"s{i}"][m] for m in ("count", "mean", "std", "min")], *quartiles[c], moments[f"s{i}"]["max"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, "
              "max double")


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5, flag_above: float = 5.0) -> DataFrame:
    """Rows strictly outside [q25 - k*IQR, q75 + k*IQR]; the percentage is of all rows."""
    rows = []
    quartiles = quantile_values(df, cols, [0.25, 0.75])
    for i, c in enumerate(cols):
        q1, q3 = quartiles[c]
        lower = double_text(None if q1 is None else q1 - k * (q3 - q1))
        upper = double_text(None if q1 is None else q3 + k * (q3 - q1))
        rows.append(
            f"struct({sql_text(c)} AS column, {lower} AS lower_bound, {upper} AS upper_bound, "
            f"count_if(x{i} < {lower} OR x{i} > {upper}) AS cnt, count(*) AS n)")
    found = numbers(df, cols).agg(F.expr(f"array({', '.join(rows)}) AS rows")).select(F.inline("rows"))
    pct = percentage(F.col("cnt"), F.col("n"))
    return found.select(
        "column", "lower_bound", "upper_bound", "cnt", pct.alias("pct"), (pct > flag_above).alias("flagged"))


def crosstab_rate(df: DataFrame, cat: str, target: str = "target") -> DataFrame:
    """Share of each class within every category: the category and one `share_<class>` column per class of the target."""
    counts = df.where(quoted(cat).isNotNull() & quoted(target).isNotNull()).groupBy(quoted(cat).alias(cat), quoted(target).alias("_t")) \
        .agg(F.count("*").alias("_n"))
    return class_shares(counts, cat)


def class_shares(counts: DataFrame, cat: str) -> DataFrame:
    """The shares from counts `_n` per category and class `_t`."""
    classes = sorted(r["_t"] for r in counts.select("_t").distinct().collect())  # they become columns
    total = F.sum("_n")
    return counts.groupBy(quoted(cat)).agg(*[
        F.try_divide(F.coalesce(F.sum(F.when(F.col("_t") == v, F.col("_n"))), F.lit(0)).cast("double"), total.cast("double"))
        .alias(f"share_{v}") for v in classes])


def density_histogram(df: DataFrame, cols: list[str], by: str = "target", bins: int = 50) -> DataFrame:
    """Equal-width density histogram of every column within every class, however many classes there are.

    The bins span the class's own minimum and maximum, and the last bin includes the maximum. Returns
    `column`, `by`, `bin`, `lower_edge`, `upper_edge`, `cnt`, `density`, empty bins included.
    """
    values = df.where(quoted(by).isNotNull()).select(quoted(by).alias("by"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), number(df, c).alias("x")) for c in cols]))).where("x IS NOT NULL")
    limits = values.groupBy("column", "by").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    flat = F.col("lo") == F.col("hi")
    limits = checkpointed(limits.select(
        "column", "by", "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins).alias("width")))
    side = F.broadcast(limits) if is_small(limits) else limits
    place = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = values.join(side, ["column", "by"]).groupBy("column", "by", place.alias("bin")).agg(F.count("*").alias("found"))
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cnt = F.coalesce(F.col("found"), F.lit(0))
    return grid.join(counts, ["column", "by", "bin"], "left").select(
        "column", "by", "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lower_edge"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper_edge"),
        cnt.alias("cnt"), (cnt / (F.col("n") * F.col("width"))).alias("density"),
    )
