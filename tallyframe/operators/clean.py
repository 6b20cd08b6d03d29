"""Row-wise cleaning and outlier replacement."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.expressions import LOW_LABEL_PATTERN, SENTINEL, low_class_flag, number, strict_number
from tallyframe.operators.profile import available, columns_by_role
from tallyframe.operators.quantiles import quantile_values
from tallyframe.session import quoted


def with_target(df: DataFrame, label: str = "label", pattern: str = LOW_LABEL_PATTERN, out: str = "target") -> DataFrame:
    return df.withColumn(out, low_class_flag(quoted(label), pattern))


def sentinel_to_null(df: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """Null out the sentinel in every string column."""
    return df.withColumns({
        c: F.nullif(quoted(c), F.lit(sentinel)) for c in columns_by_role(df)["categorical"]
    })


def normalize_strings(df: DataFrame, null_token: str | None = None, sentinel: str | None = None) -> DataFrame:
    """Trim every string column.

    With `sentinel`, a trimmed sentinel becomes null as well. With `null_token` (the classic table reader
    shows it as `nan`) nulls turn into that text and form a category of their own.
    """
    def clean(c):
        text = F.trim(quoted(c))
        if sentinel is not None:
            text = F.nullif(text, F.lit(sentinel))
        return text if null_token is None else F.coalesce(text, F.lit(null_token))

    return df.withColumns({c: clean(c) for c in columns_by_role(df)["categorical"]})


def clean_text(df: DataFrame, null_token: str | None = None, padded_sentinel: str = "null") -> DataFrame:
    """Sentinels to nulls and trimmed text, as both jobs need it.

    `padded_sentinel="keep"` with `null_token="nan"` treats text as the classic scripts do: a sentinel with blanks
    around it survives as a category of its own, and missing text becomes the category `nan`.
    """
    sentinel = SENTINEL if padded_sentinel == "null" else None
    return normalize_strings(sentinel_to_null(df), null_token, sentinel)


def select_features(df: DataFrame, cols: list[str], keep: tuple[str, ...] = ("target",)) -> DataFrame:
    """The wanted columns that exist, followed by the columns to keep."""
    return df.select(*[quoted(c) for c in [*available(df, cols), *keep]])


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text that is not a number becomes null; numeric columns stay as they are."""
    return df.withColumns({
        c: strict_number(quoted(c)) if isinstance(df.schema[c].dataType, T.StringType) else quoted(c).try_cast("double")
        for c in cols if not isinstance(df.schema[c].dataType, T.NumericType)
    })


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill({c: v for c, v in values.items() if c in df.columns})


def top_value(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column, the smallest one on ties.

    Counting per value first keeps the work spread out even when one value fills most of the column.
    """
    found = {}
    for dtype in sorted({df.schema[c].dataType.simpleString() for c in cols}):
        same = [c for c in cols if df.schema[c].dataType.simpleString() == dtype]
        value = (lambda c: number(df, c)) if dtype in ("double", "float") else quoted
        best = (
            df.select(*[value(c).alias(f"v{i}") for i, c in enumerate(same)])
            .unpivot([], [f"v{i}" for i in range(len(same))], "column", "value")
            .where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count("*").alias("cnt"))
            .groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("order"), "value")).alias("best"))
        )
        found.update({same[int(r["column"][1:])]: r["best"]["value"] for r in best.collect()})
    return {c: found.get(c) for c in cols}


def mode_or_median(df: DataFrame, col: str, where=None):
    """Mode of the rows that satisfy `where`; if there are none, the median of the whole column."""
    mode = top_value(df if where is None else df.where(where), [col])[col]
    return mode if mode is not None else quantile_values(df, [col], [0.5])[col][0]


def replace_invalid_with_mode(df: DataFrame, col: str, invalid: float = 0) -> DataFrame:
    """Replace `invalid` by the mode of the larger values, or by the median if there are none."""
    x = quoted(col)
    fill = mode_or_median(df, col, x > invalid)
    return df.withColumn(col, F.when(x == invalid, F.lit(fill)).otherwise(x))


def extreme_limits(df: DataFrame, cols: list[str], q: float = 0.99) -> dict[str, tuple]:
    """Per column the cutoff (the q-quantile) and the mode of the values that do not exceed it."""
    cutoffs = {c: v[0] for c, v in quantile_values(df, cols, [q]).items()}
    kept = df.select(*[
        F.when(number(df, c) <= F.lit(cutoffs[c]).cast("double"), quoted(c)).alias(c) for c in cols
    ])
    modes = top_value(kept, cols)
    return {c: (cutoffs[c], 0 if modes[c] is None else modes[c]) for c in cols}


def cap_extreme_with_mode(df: DataFrame, cols: list[str], q: float = 0.99) -> DataFrame:
    """Replace values above the q-quantile by the mode of the other values; every row is kept."""
    limits = extreme_limits(df, cols, q)
    return df.withColumns({
        c: F.when(number(df, c) > F.lit(cutoff).cast("double"), F.lit(mode)).otherwise(quoted(c))
        for c, (cutoff, mode) in limits.items()
    })


def extreme_report(df: DataFrame, cols: list[str], q: float = 0.99) -> DataFrame:
    """What `cap_extreme_with_mode` replaces: `column`, `cutoff`, `mode`, `replaced`."""
    limits = extreme_limits(df, cols, q)
    wide = df.agg(*[
        F.count_if(number(df, c) > F.lit(limits[c][0]).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(limits[c][0]).cast("double").alias("cutoff"),
                 F.lit(limits[c][1]).cast("double").alias("mode"), F.col(f"v{i}").alias("replaced"))
        for i, c in enumerate(cols)
    ])))
