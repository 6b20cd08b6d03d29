"""Column expressions used across the operators."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import quoted

# The two label patterns for the low class, the sentinel for "missing", what counts as a number,
# and the texts shown for a prediction.
LOW_LABEL_PATTERN = r"-\s*50000"
LOW_LABEL_PATTERN_ONE_SPACE = "- 50000"
SENTINEL = "?"
NUMBER_PATTERN = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
PREDICTION_TEXT = {0: "≤$50K", 1: ">$50K"}


def number(df: DataFrame, name: str) -> Column:
    """`name` as a double in which NaN counts as missing."""
    dtype = df.schema[name].dataType
    value = quoted(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value.cast("double")


def numbers(df: DataFrame, cols: list[str], *also: Column) -> DataFrame:
    """The columns as doubles named x0, x1, ..., so that wide aggregates can be written as SQL text."""
    return df.select(*also, *[number(df, c).alias(f"x{i}") for i, c in enumerate(cols)])


def sql_text(value: str) -> str:
    """A string literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_text(value: float | None) -> str:
    """A double literal in SQL text."""
    if value is None:
        return "cast(NULL AS double)"
    value = float(value)
    if math.isfinite(value):
        return f"{value!r}D"
    return f"cast('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}' AS double)"


def strict_number(text: Column) -> Column:
    """Text as a double, null unless all of it is a number; type suffixes such as `12d` are not."""
    return F.when(text.rlike(NUMBER_PATTERN), F.btrim(text, F.lit(" \t\n\r\x0b\x0c")).try_cast("double"))


def low_class_flag(label: Column, pattern: str = LOW_LABEL_PATTERN) -> Column:
    """0 where the label matches `pattern`, otherwise 1; a null label counts as 1."""
    return F.when(F.coalesce(label.rlike(pattern), F.lit(False)), 0).otherwise(1)


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def ellipsize(text: Column, width: int, always: bool = False) -> Column:
    """First `width` characters followed by `...`; short text stays as it is unless `always`."""
    cut = F.concat(F.substring(text, 1, width), F.lit("..."))
    return cut if always else F.when(F.length(text) > width, cut).otherwise(text)


def title_label(text: Column) -> Column:
    """`avg_weeks_worked` -> `Avg Weeks Worked`."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def marker_size(rows: Column, factor: float) -> Column:
    return F.log10(rows.cast("double")) * F.lit(float(factor))


def prediction_text(prediction: Column) -> Column:
    return F.when(prediction == 1, PREDICTION_TEXT[1]).otherwise(PREDICTION_TEXT[0])


def n_log_n(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))
