"""What several operators share: stored tables, gapless numbers, cells that follow an order, per-worker state."""

import math
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import quoted

# Tables up to this many rows and bytes may be broadcast; callers measure first or have a proof.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
# An Arrow batch of texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2_000
# Rows of a cell, a bucket or a tile: enough to amortise a task, few enough for its memory.
CELL_ROWS = 500
MAX_CELLS = 65_536


def shared_folder(spark) -> str:
    """A new path below spark.checkpoint.dir. Without that setting it is a temporary folder on a local master, whose one process
    is all of Spark, and an error on a cluster, whose executors don't share such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once into the shared folder and return the table read from there, so nothing before it runs again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after holding its session's Arrow batches to BATCH_BYTES and BATCH_ROWS: texts are long, and a task has several
    batches in memory at once. Smaller settings stay."""
    conf = df.sparkSession.conf
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?[0-9]+)([kmgt]?)b?", conf.get(key).strip().lower()).groups()
        now = int(number) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit]
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df


def small(df: DataFrame) -> bool:
    """Measure whether a table of numbers and short strings may be broadcast (one aggregate)."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(16))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"] <= BROADCAST_ROWS and row["b"] <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """The right side of a join: with a broadcast hint where its measured size allows, else for a regular join."""
    return F.broadcast(df) if small(df) else df


def sampled(df: DataFrame, by: str, rows: int) -> DataFrame:
    """About `rows` rows of `df`, spread by a hash of the column `by`: rows equal in it are all taken or none."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(quoted(by), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def packed(df: DataFrame, **columns) -> DataFrame:
    """`df` with its columns in one struct `own`, beside the given ones: no name of the table can clash, and `own.*` gives it back."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("own"), *[c.alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Gapless numbers from 0 within each group of `by`, also where one group holds most rows.

    Every group is cut into buckets by a hash of `order`; buckets are numbered on their own and start after the earlier
    ones of their group. `df` should be stored: it is read twice. Rows equal in `order` get any of their numbers.
    """
    buckets = max(1, math.ceil(rows / max(CELL_ROWS, math.isqrt(rows))))
    keys = [*by, "_bucket"]
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(name), *order), F.lit(buckets)))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return cut.withColumn("_own", own).join(starts, keys).withColumn(name, F.col("_own") + F.col("_start")) \
        .drop("_own", "_start", "_bucket")


def ordered_cells(df: DataFrame, column: str) -> tuple[F.Column, int]:
    """A number that grows with `column` (null: first) and cuts the rows into cells of about CELL_ROWS rows.

    64 quantile steps even out the spacing of the values; each step is cut evenly. Returns the column and the number of
    cells, which never exceeds MAX_CELLS.
    """
    value = F.col(column).cast("double")
    n = df.count()
    cells = min(MAX_CELLS, max(1, math.ceil(n / CELL_ROWS)))
    cuts = df.select(value.alias("v")).approxQuantile("v", [i / 64 for i in range(65)], 0.001) if cells > 1 else []
    cuts = sorted(set(cuts))
    if len(cuts) < 2:
        return F.lit(0).cast("long"), 1
    each = math.ceil(cells / (len(cuts) - 1))
    lows = F.array(*[F.lit(c) for c in cuts])
    step = F.least(F.greatest(F.size(F.filter(lows, lambda c: c <= value)), F.lit(1)), F.lit(len(cuts) - 1))
    low, high = F.element_at(lows, step), F.element_at(lows, step + 1)
    place = F.least(F.greatest(F.floor((value - low) / (high - low) * each), F.lit(0)), F.lit(each - 1))
    cell = F.coalesce((step - 1) * each + place, F.lit(0)).cast("long")
    return cell, each * (len(cuts) - 1)


def worker_state(key, make):
    """What `make` returned when this Python worker first asked for `key`; functions sent by value have no lasting globals."""
    home = sys.modules.setdefault("_tallyframe_worker_state", types.ModuleType("_tallyframe_worker_state"))
    if not hasattr(home, "kept"):
        home.kept = {}
    if key not in home.kept:
        home.kept[key] = make()
    return home.kept[key]


def forget_worker_state() -> None:
    """Drop what earlier operators left in this Python worker; idle workers keep their memory between stages."""
    home = sys.modules.get("_tallyframe_worker_state")
    if home is not None:
        home.kept = {}
    pa.default_memory_pool().release_unused()


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string column, nulls as empty."""
    return [x or b"" for x in column.cast("large_binary").to_pylist()]
