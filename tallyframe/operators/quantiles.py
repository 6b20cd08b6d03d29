"""Exact, linearly interpolated quantiles by radix selection.

A double becomes a 64-bit key of the same order. A pass counts the keys by their next bits, with the least and the largest key
of every cell, in one small aggregate for all columns; the cells that hold a wanted rank are what the next pass looks into.
A cell of one distinct value is done at once. No values are shuffled, whatever their number or their ties.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.expressions import double_text, number, numbers
from tallyframe.session import checkpointed, is_small, quoted

RANGE_ROWS = 1_000_000


def in_ranges(df: DataFrame, value: str, rows: int, range_rows: int, out: str = "part") -> DataFrame:
    """Add the number of the range of about `range_rows` rows that the double `value` (null and NaN: range 0) falls into."""
    n = math.ceil(rows / range_rows)
    finite = F.abs(F.col(value)) < F.lit(float("inf"))
    cuts = sorted(set(df.where(finite).approxQuantile(value, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not cuts:
        return df.withColumn(out, F.lit(0))
    edges = [-math.inf, *cuts, math.inf]
    cut = Bucketizer(splits=edges, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)
    return cut.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)).cast("int"))


def numbered_in_ranges(
    df: DataFrame, by: list[str], value: str, out: str, range_rows: int = RANGE_ROWS, also: str | None = None,
    weight: Column | None = None, descending: bool = False,
) -> DataFrame:
    """Add the running sum of `weight` (default: of rows) within each group in the order of `value`, then of `also`.

    The sum includes the row itself. `df` should be stored: it is read more than once.
    """
    ranged = in_ranges(df, value, df.count(), range_rows, "_part").withColumn("_weight", F.lit(1) if weight is None else weight)
    sort = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    inside = Window.partitionBy(*by, "_part").orderBy(sort(value), *([also] if also else [])).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(sort("_part")).rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy(*by, "_part").agg(F.sum("_weight").alias("_n")).select(
        *by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    summed = ranged.withColumn("_own", F.sum("_weight").over(inside))
    joined = summed.join(shift, [*by, "_part"])
    return joined.withColumn(out, F.col("_own") + F.col("_shift")).drop("_part", "_weight", "_own", "_shift")


def _keys(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are one value."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _doubles(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _between(low, high, share):
    """The value at a share of the way from one value to the next: itself where they are equal."""
    return low if low == high else low + (high - low) * share


# Rows of a cell that one window may order.
WINDOW_ROWS = 1 << 17


@F.arrow_udf(T.LongType())
def _key(x: pa.Array) -> pa.Array:
    return pa.array(_keys(x.fill_null(0.0).to_numpy(zero_copy_only=False)), mask=x.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def _value(keys: pa.Array) -> pa.Array:
    return pa.array(_doubles(keys.to_numpy(zero_copy_only=False)))


def grouped_quantiles(
    df: DataFrame, keys: list[str], cols: list[str], probs: list[float], window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Exact quantiles per key: one row per key, column and probability: keys, `column`, `prob`, `value`.

    Groups of `window_rows` rows at most are ordered as they are, in one pass over the columns. If one is larger, all take
    four passes of 16 bits at most, as aggregates per group and cell: a group has 65,536 cells at most, also one that holds
    most rows. Once no searched cell has more than `window_rows` rows, a pass looks at their values as they are. Rows with a
    null key are left out.
    """
    names = [f"key{i}" for i in range(len(keys))]
    for k in keys:
        df = df.where(quoted(k).isNotNull())
    def unpivoted(value):
        columns = [value(number(df, c)).alias(f"x{i}") for i, c in enumerate(cols)]
        found = df.select(*[quoted(k).alias(n) for k, n in zip(keys, names)], *columns)
        return found.unpivot(names, [f"x{i}" for i in range(len(cols))], "column", "k").where("k IS NOT NULL")

    by, stats = [*names, "column"], [F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")]
    position = lambda p: (F.col("total") - 1) * F.lit(float(p))  # noqa: E731  its floor and its ceiling are the ranks to look up
    ranks = F.flatten(F.array(*[F.array(
        F.struct(F.lit(i).alias("i"), F.lit(0).alias("end"), F.floor(position(p)).alias("rank"), (position(p) - F.floor(position(p))).alias("w")),
        F.struct(F.lit(i).alias("i"), F.lit(1).alias("end"), F.ceil(position(p)).alias("rank"), (position(p) - F.floor(position(p))).alias("w")))
        for i, p in enumerate(probs)]))
    largest = df.groupBy(*[quoted(k) for k in keys]).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        group = Window.partitionBy(*by)
        counted = unpivoted(lambda x: x).repartition(*by).groupBy(*by, "k").agg(F.count("*").alias("n"))
        counted = counted.withColumns({
            "total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))})
        holds = lambda rank: (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
        hit = F.lit(False)
        for p in probs:
            hit = hit | holds(F.floor(position(p))) | holds(F.ceil(position(p)))
        done = counted.where(hit).select(*by, F.col("k").alias("x"), F.inline(F.filter(ranks, lambda t: holds(t["rank"]))))
    else:
        values = unpivoted(_key)
        done = _by_cells(values, by, stats, ranks, window_rows).withColumn("x", _value("k"))
    ends = done.groupBy(*by, "i").agg(
        F.max(F.when(F.col("end") == 0, F.col("x"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("x"))).alias("high"), F.max("w").alias("w"))
    low, high = F.col("low"), F.col("high")
    original = F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("column", 2, 9).cast("int") + 1)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    return ends.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], original.alias("column"), prob.alias("prob"),
                       F.when(low == high, low).otherwise(low + (high - low) * F.col("w")).alias("value"))


def _by_cells(values: DataFrame, by: list[str], stats: list[Column], ranks: Column, window_rows: int) -> DataFrame:
    """The wanted ranks with their keys `k`, by counts per group and cell."""
    active, done = None, None
    shift, last = 48, 64
    while True:
        cell = F.shiftright("k", shift).alias("cell")
        if active is None:
            within = by
            cells = values.groupBy(*by, cell).agg(*stats).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
            cells = cells.withColumn("wanted", ranks)
        else:
            within = [*by, "above"]
            side = F.broadcast(active) if is_small(active) else active
            cells = values.withColumn("above", F.shiftright("k", last)).join(side, within).groupBy(*within, cell) \
                .agg(*stats, F.any_value("wanted").alias("wanted"))
        upto = F.sum("n").over(Window.partitionBy(*within).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        before = F.col("upto") - F.col("n")
        inside = F.transform(F.filter("wanted", lambda t: (t["rank"] >= before) & (t["rank"] < F.col("upto"))),
                             lambda t: t.withField("rank", t["rank"] - before))
        hits = checkpointed(cells.withColumn("upto", upto).select(*by, F.col("cell").alias("above"), "lo", "hi", "n", inside.alias("wanted"))
                            .where(F.size("wanted") > 0))
        found = hits.where("lo = hi").select(*by, F.col("lo").alias("k"), F.inline("wanted"))
        done = found if done is None else done.unionByName(found)
        active = hits.where("lo < hi").select(*by, "above", "wanted")
        most = hits.where("lo < hi").agg(F.max("n")).first()[0]
        if most is None:
            break
        shift, last = (0 if most <= window_rows else shift - 16), shift
    return done


# Cells of a pass over all columns together, and values that are fetched once so few are left.
PASS_CELLS = 1 << 18
FETCH_ROWS = 1 << 18


class _Search:
    """Ranks wanted of one column: cells they lie in, as key ranges of 2 ** bits, with the rows before each."""

    def __init__(self):
        self.starts, self.before, self.rows = np.zeros(1, np.uint64), np.zeros(1, np.int64), 0
        self.wanted, self.found = None, {}

    def look(self, cells: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int, step: int, ranks=None):
        """Take the counts of a pass (cells ascending) in; cells that hold a wanted rank and several values stay."""
        interval, digit = cells >> step, (cells & ((1 << step) - 1)).astype(np.uint64)
        ends = np.cumsum(n)
        first = np.r_[True, interval[1:] != interval[:-1]] if len(n) else np.zeros(0, bool)
        base = self.before[interval] - (ends - n)[first][np.cumsum(first) - 1]  # rows before, shifted to the interval's own
        start, end = base + ends - n, base + ends
        if ranks is not None:
            self.wanted = ranks(int(n.sum()))
        at = np.searchsorted(end, self.wanted, "right")
        one = lo[at] == hi[at]
        self.found |= dict(zip(self.wanted[one].tolist(), lo[at][one].tolist()))
        self.wanted, at = self.wanted[~one], np.unique(at[~one])
        self.before, self.rows = start[at], int(n[at].sum())
        self.starts = self.starts[interval[at]] + (digit[at] << np.uint64(bits - step))

    def fetch(self, keys: np.ndarray, n: np.ndarray, bits: int):
        """Take all keys of the remaining cells, ascending, with their counts."""
        interval = np.searchsorted(self.starts, keys.view(np.uint64) ^ np.uint64(1 << 63), "right") - 1
        ends = np.cumsum(n)
        first = np.r_[True, interval[1:] != interval[:-1]]
        end = self.before[interval] - (ends - n)[first][np.cumsum(first) - 1] + ends
        self.found |= dict(zip(self.wanted.tolist(), keys[np.searchsorted(end, self.wanted, "right")].tolist()))
        self.wanted = self.wanted[:0]


def _cells_of(keys: np.ndarray, starts: np.ndarray, bits: int, step: int) -> np.ndarray:
    """Number of the cell of every key, -1 outside all key ranges."""
    key = keys.view(np.uint64) ^ np.uint64(1 << 63)
    at = np.searchsorted(starts, key, "right") - 1
    digit = (key - starts[np.maximum(at, 0)]) >> np.uint64(bits - step)
    return np.where((at >= 0) & (digit < (1 << step)), (at << step) | digit.astype(np.int64), -1)


def _known(b: pa.RecordBatch, i: int, weighted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys of the values of a column, ascending, and the rows that each stands for, if the last column tells."""
    column = b.column(i)
    keys = _keys(column.drop_null().to_numpy(zero_copy_only=False))
    if not weighted:
        return np.sort(keys), None
    order = np.argsort(keys)
    return keys[order], b.column(b.num_columns - 1).filter(column.is_valid()).to_numpy(zero_copy_only=False)[order]


def _passes(x: DataFrame, open_: dict[int, np.ndarray], bits: int, step: int, weighted: bool = False) -> pd.DataFrame:
    """(column, cell, n, lo, hi) over all columns in `open_`: one pass, added up on the executors."""
    def count(batches):
        sums = {}
        for b in batches:
            for i, starts in open_.items():
                keys, weights = _known(b, i, weighted)
                cells = _cells_of(keys, starts, bits, step)
                keys, weights, cells = keys[cells >= 0], weights[cells >= 0] if weighted else None, cells[cells >= 0]
                if not len(keys):
                    continue
                first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                last = np.r_[first[1:], len(keys)] - 1
                n, lo, hi = sums.setdefault(i, (np.zeros(len(starts) << step, np.int64), np.full(len(starts) << step, np.iinfo(np.int64).max),
                                                np.full(len(starts) << step, np.iinfo(np.int64).min)))
                at = cells[first]
                n[at] += np.add.reduceat(weights, first) if weighted else last - first + 1
                lo[at], hi[at] = np.minimum(lo[at], keys[first]), np.maximum(hi[at], keys[last])
        for i, (n, lo, hi) in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(n[at]), pa.array(lo[at]), pa.array(hi[at])],
                                             names=["column", "cell", "n", "lo", "hi"])

    parts = x.mapInArrow(count, "column int, cell long, n long, lo long, hi long")
    return parts.groupBy("column", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")) \
        .toArrow().to_pandas().sort_values(["column", "cell"])  # PASS_CELLS rows at most


def _fetched(x: DataFrame, open_: dict[int, np.ndarray], bits: int, weighted: bool = False) -> pd.DataFrame:
    """(column, k, n): the distinct keys in the cells that are left, which hold FETCH_ROWS rows at most."""
    def run(batches):
        for b in batches:
            for i, starts in open_.items():
                keys, weights = _known(b, i, weighted)
                here = _cells_of(keys, starts, bits, 0) >= 0
                keys, first, n = np.unique(keys[here], return_index=True, return_counts=True)
                if weighted and len(keys):
                    n = np.add.reduceat(weights[here], first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(n)], names=["column", "k", "n"])

    parts = x.mapInArrow(run, "column int, k long, n long").groupBy("column", "k").agg(F.sum("n").alias("n"))
    return parts.toArrow().to_pandas().sort_values(["column", "k"])


def order_statistics(
    df: DataFrame, cols: list[str], ranks, pass_cells: int = PASS_CELLS, fetch_rows: int = FETCH_ROWS, weight: str = ""
) -> list[tuple[int, dict[int, float]]]:
    """Per column the number of its values and {rank: value} for the ranks from 0 that `ranks(place of the column, number of
    values)` asks for; (0, {}) for a column without values.

    Every pass reads the columns once and sends counts of `pass_cells` cells at most to the driver, or of two per cell
    still searched where there are more of these; once the searched cells hold `fetch_rows` rows or fewer, their values come.
    `weight` names a column of whole numbers that tell how many rows a row stands for.
    """
    if not cols:
        return []
    x = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(cols)], quoted(weight).cast("long").alias("weight")) if weight else numbers(df, cols)
    searches, totals, found = {i: _Search() for i in range(len(cols))}, {}, {}
    bits, first = 64, True
    while searches:
        open_ = {i: s.starts for i, s in searches.items()}
        if not first and sum(s.rows for s in searches.values()) <= fetch_rows:
            rows = _fetched(x, open_, bits, bool(weight))
            for i, part in rows.groupby("column"):
                searches[i].fetch(part["k"].to_numpy(), part["n"].to_numpy(), bits)
            break
        step = max(1, min(bits, 16, (pass_cells // sum(map(len, open_.values()))).bit_length() - 1))
        rows = _passes(x, open_, bits, step, bool(weight))
        for i, part in rows.groupby("column"):
            def wanted(n, i=i):
                totals[i] = n
                return np.unique(np.asarray(ranks(i, n), dtype=np.int64))

            searches[i].look(*(part[c].to_numpy() for c in ("cell", "n", "lo", "hi")), bits, step, wanted if first else None)
        for i in [i for i, s in searches.items() if s.wanted is None or not len(s.wanted)]:
            found[i] = searches.pop(i).found
        bits, first = bits - step, False
    found |= {i: s.found for i, s in searches.items()}
    return [(totals.get(i, 0), dict(zip(found[i], _doubles(np.array(list(found[i].values()), np.int64)).tolist()))) for i in range(len(cols))]


def ranks_around(n: int, probs: list[float]) -> np.ndarray:
    """The ranks among n values between which the quantiles lie."""
    place = (n - 1) * np.array([float(p) for p in probs])
    return np.unique(np.r_[np.floor(place), np.ceil(place)]).astype(np.int64)


def interpolated(n: int, probs: list[float], value_at) -> list[float | None]:
    """Quantiles of n values, `value_at(rank)` being the values around them; None for no values."""
    places = ((n - 1) * float(p) for p in probs)
    return [_between(value_at(math.floor(p)), value_at(math.ceil(p)), p - math.floor(p)) if n else None for p in places]


def quantile_values(
    df: DataFrame, cols: list[str], probs: list[float], pass_cells: int = PASS_CELLS, fetch_rows: int = FETCH_ROWS, weight: str = ""
) -> dict[str, list[float | None]]:
    """Quantiles of every column as plain numbers, ready to be used as literals; None for a column without values."""
    found = order_statistics(df, cols, lambda _, n: ranks_around(n, probs), pass_cells, fetch_rows, weight)
    return {c: interpolated(n, probs, at.__getitem__) for c, (n, at) in zip(cols, found)}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> DataFrame:
    """One row per column and probability: `column`, `prob`, `value`."""
    if exact:
        values = quantile_values(df, cols, probs)
    else:
        grid = f"array({', '.join(double_text(p) for p in probs)})"
        row = numbers(df, cols).agg(*[
            F.expr(f"percentile_approx(x{i}, {grid}) AS q{i}") for i in range(len(cols))]).first()
        values = {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, values[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
