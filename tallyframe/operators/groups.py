"""Group profiles: one row per key, and what is derived from that table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expressions import ellipsize, marker_size, number
from tallyframe.operators.quantiles import grouped_quantiles, quantile_values
from tallyframe.session import checkpointed, is_small, quoted

SIMPLE_STATS = {
    "mean": F.avg, "std": F.stddev_samp, "count": F.count, "min": F.min, "max": F.max, "sum": F.sum,
}


def group_profile(df: DataFrame, key: str, stats: dict[str, list[str]], digits: int | None = 2) -> DataFrame:
    """One row per non-null key with a `<column>_<stat>` column per wanted statistic.

    Statistics: mean, std (sample), count, min, max, sum, median. Results are rounded half-even. Medians come from the
    value counts of the groups, so that a dominant key is not held by one task.
    """
    rows = df.where(quoted(key).isNotNull())
    medians = [c for c, wanted in stats.items() if "median" in wanted]
    out = rows.groupBy(quoted(key).alias(key)).agg(*[
        SIMPLE_STATS[s](number(df, c)).alias(f"{c}_{s}") for c, wanted in stats.items() for s in wanted if s != "median"
    ]) if any(s != "median" for wanted in stats.values() for s in wanted) else rows.select(quoted(key)).distinct()
    if medians:
        found = grouped_quantiles(rows, [key], medians, [0.5])
        found = found.groupBy(quoted(key)).agg(*[
            F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in medians])
        out = out.join(found, key, "left")
    order = [f"{c}_{s}" for c, wanted in stats.items() for s in wanted]
    out = out.select(quoted(key), *[quoted(c) for c in order])
    return out if digits is None else round_stats(out, digits)


def round_stats(df: DataFrame, digits: int) -> DataFrame:
    """Round every floating-point column half-even, on the scaled double (as array libraries do)."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    unit = F.lit(10.0 ** digits)
    return df.withColumns({c: F.rint(quoted(c) * unit) / unit for c in names})


def min_group_size(df: DataFrame, size: str, n: int = 100) -> DataFrame:
    return df.where(quoted(size) >= n)


def segment_features(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The key and the renamed profile columns: `{new name: profile column}`."""
    return df.select(quoted(key), *[quoted(src).alias(new) for new, src in columns.items()])


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(quoted(key)).where(quoted(key).isNotNull()).distinct().orderBy(quoted(key))


def running_number(df: DataFrame, order: list[Column], out: str = "rank", start: int = 1) -> DataFrame:
    """Number all rows in the given total order.

    A table that was measured to be small is numbered in one window. A larger one is sorted into ranges and
    stored; the sizes of the earlier ranges then shift the number inside each range.
    """
    if is_small(df):
        number_in_order = F.row_number().over(Window.orderBy(*order))
        return df.withColumn(out, (number_in_order + (start - 1)).cast("long"))
    shift = 2 ** 33  # monotonically_increasing_id keeps the partition above this bit
    ranged = checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.floor(F.col("_id") / shift)).withColumn("_pos", F.col("_id") % shift)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(out, F.col("_before") + F.col("_pos") + start)
        .drop("_id", "_part", "_pos", "_before")
    )


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(quoted(by).desc_nulls_last(), quoted(tie)).limit(k)


def rank_groups(df: DataFrame, by: str, key: str, out: str = "rank") -> DataFrame:
    """Rank 1..n by the measure, largest first; equal measures in key order."""
    return running_number(df, [quoted(by).desc_nulls_last(), quoted(key)], out)


def best_by(df: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the largest metric; the smallest `order` value wins a tie."""
    return top_k(df, metric, 1, order)


def quartile_bands(df: DataFrame, col: str) -> DataFrame:
    """Rows labelled `high` (>= q75), `mid` (strictly between) or `low` (<= q25).

    The high and low tests both include their cutoff, so a row falls into both bands where q25 = q75.
    """
    low, high = quantile_values(df, [col], [0.25, 0.75])[col]
    low, high = (F.lit(v).cast("double") for v in (low, high))
    x = number(df, col)
    bands = F.array_compact(F.array(
        F.when(x >= high, "high"), F.when((x < high) & (x > low), "mid"), F.when(x <= low, "low")
    ))
    return df.withColumn("band", F.explode(bands))


def cluster_summary(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Size and column means per cluster."""
    return df.groupBy(quoted(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), *[F.avg(number(df, c)).alias(f"mean_{c}") for c in cols]
    )


def cluster_members(df: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """The member list of every cluster, one row per member, in cluster and key order."""
    return df.select(quoted(cluster).alias("cluster"), quoted(key).alias("member")).orderBy("cluster", "member")


def attach_size(df: DataFrame, features: DataFrame, key: str, size: str = "sample_size") -> DataFrame:
    """Look up the sample size of every group by its key."""
    return df.join(features.select(quoted(key), quoted(size)), key, "inner")


def segment_plot_data(
    df: DataFrame, key: str, x: str = "avg_age", y: str = "avg_weeks_worked", z: str = "high_income_rate",
    size: str = "sample_size",
) -> DataFrame:
    """Everything the 3-D scatter and its three projections show, one row per group."""
    rows = quoted(size)
    label = quoted(key)
    table = df.select(
        label.alias("key"), quoted(x).alias("x"), quoted(y).alias("y"), quoted(z).alias("z"),
        rows.alias("sample_size"),
        marker_size(rows, 50).alias("size_3d"), marker_size(rows, 30).alias("size_2d"),
        ellipsize(label, 20).alias("legend_3d"), ellipsize(label, 15).alias("legend_2d"),
        F.when(rows > 5000, ellipsize(label, 15, always=True)).alias("label_3d"),
        F.when(rows > 8000, ellipsize(label, 12, always=True)).alias("label_2d"),
    )
    return running_number(table, [F.col("key")], "color_index", start=0)
