"""Exact, repeatable sampling without a shuffle of the rows.

Rows are ordered by a hash of their unique key. The last row to keep of every class lies near the quota's share of all
hashes: one pass counts the rows before a narrow range around it and takes the rows inside. For very many classes, or where
the keys' hashes aren't spread, rows are counted per class and hash prefix instead. The sample is then a comparison with
that row. Quotas and last rows are tables with a row per class, so there may be any number of classes.
"""

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import checkpointed, is_small, quoted

PREFIX_ROWS = 1_000
# Rows around the last ones to keep that one pass takes, and their spread in standard deviations.
NEAR_ROWS = 1 << 20
NEAR_SPREAD = 8
# Classes up to which a filter names them.
FEW_CLASSES = 16


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", quoted(key).cast("string"), F.lit(str(seed))))


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a repeatable random order, as a distributed sort."""
    return df.orderBy(row_hash(key, seed), quoted(key))


def class_sizes(df: DataFrame, target: str, hashed: str = "") -> DataFrame:
    """`t`, `n`, with a column of hashes also `most`, the largest: one row per class, null included."""
    most = [F.max(quoted(hashed)).alias("most")] if hashed else []
    return df.groupBy(quoted(target).alias("t")).agg(F.count("*").alias("n"), *most)


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _unclear(repeated, h, k):
    """The hash of the last row, an error where its key occurs again behind it."""
    return F.when(repeated, F.raise_error(F.concat(F.lit("the key is not unique: "), k.cast("string")))).otherwise(h)


def _last_kept(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """`t`, `h`, `k`: hash and key of the `quota`-th row (1-based) of every class in hash order; rows: (t, h, k).

    A key that occurs more than once around that row has no definite order and is an error.
    """
    some = quotas.where("quota > 0 AND quota < n").withColumnRenamed("t", "class")
    share = F.col("quota") / F.col("n")
    spread = F.lit(NEAR_SPREAD) * (F.sqrt(share * (1 - share) / F.col("n")) + 1 / F.col("n"))
    classes, near = some.agg(F.count("*"), F.coalesce(F.sum(2 * spread * F.col("n")), F.lit(0.0))).first()
    if near <= NEAR_ROWS:
        top = F.conv(F.substring("most", 1, 8), 16, 10).cast("double") + 1 if "most" in quotas.columns else F.lit(2.0 ** 32)
        last = checkpointed(_last_near(_of_classes(rows, some), some, (share - spread) * top, (share + spread) * top))  # one row per class
        if last.count() == classes:
            return last.select("t", _unclear(F.col("repeated"), F.col("h"), F.col("k")).alias("h"), "k")
    return _last_by_prefix(rows, some, quotas.agg(F.sum("n")).first()[0] or 0)


def _of_classes(rows: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of a few classes, by a filter that spares the others their hash; all rows where there are many."""
    found = [r["class"] for r in some.select("class").limit(FEW_CLASSES + 1).collect()]
    return rows.where(F.col("t").isin(found)) if len(found) <= FEW_CLASSES and None not in found else rows


def _last_near(rows: DataFrame, some: DataFrame, low, high) -> DataFrame:
    """`t`, `h`, `k`, `repeated` of the classes whose last row lies between two hashes, given by their first 32 bits."""
    def digits(x):
        return F.lpad(F.lower(F.hex(F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(2 ** 32 - 1)).cast("long"))), 8, "0")

    ranges = some.select("class", "quota", digits(low).alias("low"), digits(high).alias("high"))
    own = F.substring("h", 1, 8)
    inside = rows.join(_hinted(ranges), F.col("t").eqNullSafe(F.col("class")) & (own <= F.col("high"))).select(
        "t", "quota", (own >= F.col("low")).alias("near"), "h", "k")
    cells = inside.groupBy("t", "quota", "near", *[F.when(F.col("near"), F.col(c)).alias(c) for c in ("h", "k")]).agg(F.count("*").alias("cnt"))
    upto = F.sum("cnt").over(Window.partitionBy("t").orderBy("near", "h", "k").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("upto", upto).where("near AND quota <= upto AND quota > upto - cnt").select(
        "t", "h", "k", (F.col("quota") < F.col("upto")).alias("repeated"))


def _last_by_prefix(rows: DataFrame, some: DataFrame, total: int) -> DataFrame:
    width = max(1, math.ceil(math.log(max(1.0, total / PREFIX_ROWS), 16)))
    rows = rows.withColumn("prefix", F.substring("h", 1, width))
    counts = rows.groupBy("t", "prefix").agg(F.count("*").alias("cnt"))
    upto = F.sum("cnt").over(Window.partitionBy("t").orderBy("prefix"))
    spots = counts.withColumn("upto", upto).join(_hinted(some.select("class", "quota")), F.col("t").eqNullSafe(F.col("class"))).where(
        "quota <= upto AND quota > upto - cnt").select("class", F.col("prefix").alias("at"), (F.expr("quota - upto + cnt")).alias("left"))
    spots = checkpointed(spots)  # one row per class
    near = rows.join(_hinted(spots), F.col("t").eqNullSafe(F.col("class")) & (F.col("prefix") == F.col("at")))
    order = Window.partitionBy("t").orderBy("h", "k")
    near = near.withColumn("position", F.row_number().over(order)).withColumn("next", F.lead(F.struct("h", "k")).over(order))
    return near.where("position = left").select(
        "t", _unclear(F.col("next").eqNullSafe(F.struct("h", "k")), F.col("h"), F.col("k")).alias("h"), "k")


def first_in_hash_order(df: DataFrame, target: str, key: str, quotas: DataFrame, seed: int = 42, hashed: str = "") -> DataFrame:
    """Add `_first`: whether a row is among the first `quota` rows of its class; quotas: (t, n, quota) per class.

    `hashed` names a column with the rows' hashes, which is added where `df` has none; without it they stay out.
    """
    own = hashed or next(c for i in itertools.count() if (c := f"_hash{i}") not in df.columns)
    kept = [*df.columns, *([hashed] if hashed and hashed not in df.columns else [])]
    if own not in df.columns:
        df = df.withColumn(own, row_hash(key, seed))
    quotas = checkpointed(quotas)
    rows = df.select(quoted(target).alias("t"), quoted(own).alias("h"), quoted(key).alias("k"))
    last = _last_kept(rows, quotas).select(F.col("t").alias("lt"), F.col("h").alias("_h"), F.col("k").alias("_k"))
    marks = checkpointed(quotas.join(last, F.col("t").eqNullSafe(F.col("lt")), "left").select(
        F.col("t").alias("_t"), (F.col("quota") >= F.col("n")).alias("_all"), "_h", "_k"))
    upto = F.struct(quoted(own).alias("h"), quoted(key).alias("k")) <= F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"))
    joined = df.join(_hinted(marks), quoted(target).eqNullSafe(F.col("_t")))
    first = F.col("_all") | F.coalesce(F.col("_h").isNotNull() & upto, F.lit(False))
    return joined.select(*[quoted(c) for c in kept], first.alias("_first"))


def downsample(df: DataFrame, target: str, key: str, seed: int = 42, hashed: str = "") -> DataFrame:
    """Reduce class 0 to exactly min(n0, n1) rows; class 1 keeps all its rows. Other classes, null too, are an error.

    `hashed` names a column to add with the rows' hashes, which `stratified_split` by the same key and seed can use again.
    """
    sizes = checkpointed(class_sizes(df, target))
    others = sizes.where("t IS NULL OR t NOT IN (0, 1)").limit(1).collect()
    if others:
        raise ValueError(f"{target} has a class other than 0 and 1: {others[0]['t']}")
    n1 = F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).over(Window.partitionBy())  # two rows
    quotas = sizes.withColumn("quota", F.least("n", n1))
    return first_in_hash_order(df, target, key, quotas, seed, hashed).where("_first").drop("_first")


def split_sizes(sizes: DataFrame, test: float) -> DataFrame:
    """`t`, `n`, ..., `quota`: test rows per class, ceil(test * n) in total, shared by largest remainder, ties to the smaller class."""
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    total = math.ceil(round(test * rows, 9))
    share = F.col("n") * F.lit(float(total)) / F.lit(float(max(rows, 1)))
    shared = checkpointed(sizes.withColumn("base", F.floor(share)).withColumn("rest", share - F.floor(share)))
    missing = total - (shared.agg(F.sum("base")).first()[0] or 0)
    lucky = shared.orderBy(F.desc("rest"), F.col("t").asc_nulls_last()).limit(missing).select(F.col("t").alias("lt"), F.lit(1).alias("more"))
    return shared.join(lucky, F.col("t").eqNullSafe(F.col("lt")), "left").select(
        *sizes.columns, (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))


def stratified_split(
    df: DataFrame, target: str, key: str, test: float = 0.3, seed: int = 42, hashed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with equal class shares; the two cover the input without overlap, whatever the number of classes.

    `hashed` names the column with the hashes of the key for this seed, if there is one.
    """
    sizes = checkpointed(class_sizes(df, target, hashed))
    marked = first_in_hash_order(df, target, key, split_sizes(sizes, test), seed, hashed)
    return marked.where("NOT _first").drop("_first"), marked.where("_first").drop("_first")
