"""What the vector operators share: whole-number vectors, and blocks of queries against blocks of rows."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, stored

# Queries and rows of a block: a task holds one of each.
QUERY_ROWS = 1024
BLOCK_ROWS = 32_768
# Scores must fit a long; by the Cauchy-Schwarz inequality they do when all squared lengths stay below this.
MOST_NORM = 2.0 ** 62


def whole_vectors(df: DataFrame, vector: str, scale: float, **columns: Column) -> tuple[DataFrame, int, float]:
    """Stored rows (row, the given columns, v) with v = floor(scale * x) of every component, their width and largest squared length.

    Rows whose vector is null or holds a null, NaN or infinite component take no part. `row` is a number of its own for every
    row, so rows that repeat stay apart. Shorter vectors count as padded by zeros. Vectors so long that a score might not fit
    a long are an error. An empty table gives none.
    """
    x = F.col(f"`{vector}`")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    grown = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    out = df.where(F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in columns.items()],
        F.transform(grown, lambda c: F.floor(c)).alias("v"),
        F.aggregate(grown, F.lit(0.0), lambda s, c: s + (F.abs(c) + 1) * (F.abs(c) + 1)).alias("norm"))
    out = stored(out)
    found = out.agg(F.max(F.size("v")).alias("width"), F.max("norm").alias("norm")).first()
    if (found["norm"] or 0) >= MOST_NORM:
        raise ValueError("vectors are too long: their inner products don't fit a long")
    return out.drop("norm"), found["width"] or 0, found["norm"] or 0.0


def in_blocks(queries: DataFrame, rows: DataFrame, bucket: list[str], run: Callable, schema: str,
              query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`run(queries, rows)` (Arrow tables) for every block of queries with every block of rows of the same bucket.

    Both sides have a unique number `row`, which deals them to blocks; `bucket` names columns of both (none: all meet). A bucket
    of any size is cut, so a task holds `query_rows` queries and `block_rows` rows on average. Rows whose bucket has no query stay out.
    """
    sizes = queries.groupBy(*bucket).agg(F.count("*").alias("_nq")).withColumn("_one", F.lit(1)).join(
        rows.groupBy(*bucket).agg(F.count("*").alias("_nr")).withColumn("_one", F.lit(1)), [*bucket, "_one"])
    sizes = stored(sizes.select(*[F.col(c).alias(f"_in_{c}") for c in bucket],
                                F.ceil(F.col("_nq") / query_rows).alias("_cuts_q"), F.ceil(F.col("_nr") / block_rows).alias("_cuts_r")))

    def dealt(df, salt, own, other):
        on = F.lit(True)
        for c in bucket:
            on = on & (F.col(c) == F.col(f"_in_{c}"))
        df = df.join(sized(sizes), on) if bucket else df.crossJoin(F.broadcast(sizes))  # one row, without buckets
        return df.withColumns({
            f"_{own}": F.pmod(F.xxhash64("row", F.lit(salt)), F.col(f"_cuts_{own}")),
            f"_{other}": F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_cuts_{other}") - 1))}) \
            .drop("_cuts_q", "_cuts_r", *[f"_in_{c}" for c in bucket])

    left, right = dealt(queries, "query", "q", "r"), dealt(rows, "row", "r", "q")
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    keys = [*bucket, "_q", "_r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, shorter ones padded by zeros."""
    lists = column.combine_chunks()
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if width and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Long integers and where they are null."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def first(chosen: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """The k of the places `chosen` with the highest scores, ties by smaller id, missing ids last."""
    if len(chosen) > k:
        own = scores[chosen]
        chosen = chosen[own >= np.partition(own, -k)[-k]]
    return chosen[np.lexsort((ids[chosen], missing[chosen], -scores[chosen]))[:k]]


