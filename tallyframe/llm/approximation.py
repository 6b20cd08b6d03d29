"""Exact top-k search by a vector-approximation file.

Every component is replaced by the number of a cell between marks of its dimension, one byte each. Scanning this file gives
bounds for the inner product of every row with every query, and only rows whose upper bound reaches the kth largest lower bound
are looked at. Their exact vectors are read in the order of their bounds (for inner products the best bound is the
largest): the first k of every query, then whatever can still beat or tie the kth of these; after that the result is certain.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, stored
from tallyframe.llm.negatives import SCORES_SQL
from tallyframe.llm.registry import query
from tallyframe.llm.vectors import BLOCK_ROWS, QUERY_ROWS, in_blocks, matrix, whole_vectors

CELLS = 64
# Inner marks come from a sample of at most so many rows and bytes; the outer ones are the true least and largest values.
MARK_ROWS = 8_192
MARK_BYTES = 16 << 20
SLICE = 64
# Whole numbers beyond this are not exact as doubles.
EXACT = 2.0 ** 53


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of least id (null: last) of every vector. No others can be among the first k of a query, since equal vectors
    have equal scores; of a large group of copies a task passes on k rows."""
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"), "row")
    return rows.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k).drop("_copy")


def marks(rows: DataFrame, width: int, cells: int = CELLS, sample_rows: int = MARK_ROWS) -> np.ndarray:
    """(width, cells + 1) ascending marks of every dimension: quantiles of a bounded sample inside the true range."""
    n = rows.count()
    take = min(sample_rows, max(cells, MARK_BYTES // (8 * max(1, width))))
    part = int(min(1.0, 1.2 * take / max(1, n)) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("row", F.lit("marks")), F.lit(1 << 30)) < part).select("v").limit(take).toArrow()
    sample = matrix(some.column("v"), width) if some.num_rows else np.zeros((1, width), np.int64)
    inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").T

    def spans(batches):
        low = high = None
        for b in batches:
            m = matrix(pa.chunked_array([b.column(0)]), width)
            if len(m):
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    ends = rows.select("v").mapInArrow(spans, "d long, low long, high long").groupBy("d").agg(F.min("low"), F.max("high"))
    out = np.zeros((width, cells + 1), np.int64)
    out[:, 1:-1] = inner
    for d, low, high in ends.collect():  # a row per dimension
        out[d, 0], out[d, -1] = low, high
    out[:, 1:-1] = np.clip(out[:, 1:-1], out[:, :1], out[:, -1:])
    return out


def approximate(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """The approximation file: (row, cells), a byte per component."""
    width = len(edges)

    def run(batches):
        for b in batches:
            m = matrix(pa.chunked_array([b.column(1)]), width)
            cells = np.empty(m.shape, np.uint8)
            for d in range(width):
                cells[:, d] = np.searchsorted(edges[d, 1:-1], m[:, d], "left")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], names=["row", "cells"])

    return rows.select("row", "v").mapInArrow(run, "row long, cells binary")


def candidates(queries: DataFrame, file: DataFrame, edges: np.ndarray, k: int,
               query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, row, most, place): rows whose largest possible score reaches the query's kth largest least score, best first."""
    width = len(edges)
    low, high = (np.ascontiguousarray(e).astype(float) for e in (edges[:, :-1], edges[:, 1:]))
    reach = (np.maximum(np.abs(edges[:, 0].astype(float)), np.abs(edges[:, -1].astype(float))) ** 2).sum()
    slack = 0.0 if reach < EXACT else reach * 2.0 ** -40

    def run(left, right):
        q, own, there = matrix(left["v"], width).astype(float), left["row"].to_numpy(), right["row"].to_numpy()
        cells = np.frombuffer(b"".join(right["cells"].to_pylist()), np.uint8).reshape(len(there), width)
        dims = np.arange(width)
        ends = np.concatenate([low[dims, cells], high[dims, cells]], 1).T
        found = [(own[:0], own[:0], np.zeros(0), np.zeros(0))]
        for at in range(0, len(q) if len(there) else 0, SLICE):
            up, down = np.maximum(q[at:at + SLICE], 0), np.minimum(q[at:at + SLICE], 0)
            most, least = np.hstack([down, up]) @ ends + slack, np.hstack([up, down]) @ ends - slack
            self_ = there[None, :] == own[at:at + SLICE, None]
            most[self_] = least[self_] = -np.inf
            # With k rows or fewer, all of them are looked at.
            cut = np.partition(least, -k, 1)[:, -k] if least.shape[1] > k else np.full(len(least), -np.inf)
            i, j = np.nonzero((most >= cut[:, None]) & ~self_)
            found.append((own[at + i], there[j], most[i, j], least[i, j]))
        parts = [np.concatenate(c) for c in zip(*found)]
        return pa.table([pa.array(c) for c in parts], names=["query", "row", "most", "least"])

    near = in_blocks(queries, file, [], run, "query long, row long, most double, least double", query_rows, block_rows)
    every = Window.partitionBy("query").orderBy(F.desc("least"), "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumn("_cut", F.nth_value("least", k).over(every)).where(
        F.col("_cut").isNull() | (F.col("most") >= F.col("_cut")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "row"))
    return near.withColumn("place", place).select("query", "row", "most", "place")


def top_k(df: DataFrame, key: Column, vector: str, asked: Column, k: int = 5, scale: float = 256.0, cells: int = CELLS,
          query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for every row where `asked` is true, its k best other rows (all, if fewer).

    Scores are inner products of floor(scale * x); ties go to the smaller key, a null key last. Rows that `whole_vectors`
    leaves out take no part. Rows that repeat are rows of their own: a query's copies are candidates, the row itself isn't.
    Other columns of `df` are not read, whatever their names.
    """
    rows, width, _ = whole_vectors(df, vector, scale, id=key.cast("long"), asked=F.coalesce(asked, F.lit(False)))
    queries = rows.where("asked").select("row", "id", "v")
    rows = stored(first_copies(rows.select("row", "id", "v"), k + 1))
    edges = marks(rows, width, cells)
    file = stored(approximate(rows, edges))
    found = stored(candidates(queries.select("row", "v"), file, edges, k, query_rows, block_rows))

    vectors = rows.select("row", "id", "v")
    asked_for = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"))

    def exact(some):
        return vectors.join(sized(some), "row").join(sized(asked_for), "query").select(
            "query", "query_id", "row", "id",
            F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))),
                        F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))

    read = stored(exact(found.where(F.col("place") <= k).select("query", "row")))
    kth = read.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    open_ = found.where(F.col("place") > k).join(kth, "query").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    read = read.unionByName(exact(open_.select("query", "row")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return read.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


@query(f"""WITH {SCORES_SQL}
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER w::INT AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def op13_exact_top_k(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    key = F.col("vec_id")
    return top_k(df, key, "embedding", key % 50 == 0).withColumnRenamed("id", "vec_id")
