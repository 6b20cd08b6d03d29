"""Numbered rows packed into blocks for operators that read them many times.

A block holds some megabytes of a partition's rows: every distinct row once, and for every row its number and the place of
its distinct row. A pass gets whole arrays instead of rows, and what depends on the values alone is worked out once per
distinct row. Blocks without equal rows are as good, they only hold more distinct rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.session import checkpointed

# Bytes of a block, and bytes of its distinct rows from which rows that come next are no longer looked up in it.
BLOCK_BYTES = 16 << 20
# Rows for which draws are made at a time, so that they stay in a core's own memory.
DRAW_ROWS = 1 << 15

_KINDS = "n long, width int, last double, row binary, place binary, y binary, x binary"
WEIGHED_KINDS = "n long, held long, bits int, y binary, x binary, w binary"


def distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct row of every row, in the order in which they first occur; the first row of each)."""
    n = len(y)
    code = pd.factorize(y)[0].astype(np.int64)
    many = int(code.max(initial=-1)) + 1
    for column in x.T:
        if many == n:
            break
        own, values = pd.factorize(column, use_na_sentinel=False)
        code, kept = pd.factorize(code * len(values) + own)
        code, many = code.astype(np.int64), len(kept)
    first = np.empty(many, np.int64)
    first[code[::-1]] = np.arange(n - 1, -1, -1)
    return code, first


class Block:
    """`row`: number of every row; `place`: its distinct row; `y` and `x`: label and values of the distinct rows."""

    def __init__(self, row: np.ndarray, place: np.ndarray, y: np.ndarray, x: np.ndarray):
        self.row, self.place, self.y, self.x = row, place, y, x

    @classmethod
    def of_rows(cls, row: np.ndarray, y: np.ndarray, x: np.ndarray) -> "Block":
        code, first = distinct(x, y)
        return cls(row, code.astype(np.int32), y[first], x[first])

    @classmethod
    def merged(cls, parts: list["Block"]) -> "Block":
        if len(parts) == 1:
            return parts[0]
        y, x = np.concatenate([p.y for p in parts]), np.concatenate([p.x for p in parts])
        code, first = distinct(x, y)
        starts = np.cumsum([0, *(len(p.y) for p in parts)])
        place = np.concatenate([code[s + p.place] for s, p in zip(starts, parts)]).astype(np.int32)
        return cls(np.concatenate([p.row for p in parts]), place, y[first], x[first])

    def coded(self, code: Callable) -> "Block":
        """The same rows with other numbers for the values, equal ones brought together."""
        x = code(self.x)
        own, first = distinct(x, self.y)
        return Block(self.row, own[self.place].astype(np.int32), self.y[first], x[first])

    @property
    def nbytes(self) -> int:
        return self.row.nbytes + self.place.nbytes + self.y.nbytes + self.x.nbytes

    def weights(self, of_rows: np.ndarray) -> np.ndarray:
        """Sums of a weight of the rows per distinct row."""
        return np.bincount(self.place, of_rows, len(self.y))

    def record(self) -> pa.RecordBatch:
        parts = [pa.array([v.tobytes()], pa.binary()) for v in (self.row, self.place, self.y, self.x)]
        sizes = [pa.array([len(self.row)]), pa.array([self.x.shape[1]], pa.int32()), pa.array([float(self.y.max())])]
        return pa.RecordBatch.from_arrays([*sizes, *parts], names=[f.split()[0] for f in _KINDS.split(", ")])


class Weighed:
    """Distinct rows without the numbers of their rows: `y`, `x` and for every tree, a row of `w`, the sums of its draws."""

    def __init__(self, n: int, y: np.ndarray, x: np.ndarray, w: np.ndarray):
        self.n, self.y, self.x, self.w = n, y, x, w

    @classmethod
    def of_block(cls, block: Block, draw: Callable, trees: list[int], most: int = 1) -> "Weighed":
        """`draw(rows, tree)` tells how often, `most` times at most, a tree draws each of some rows, by their numbers."""
        n, held = len(block.row), len(block.y)
        w = np.zeros((len(trees), held), np.min_scalar_type(most * int(np.bincount(block.place).max())))
        step = DRAW_ROWS if held <= DRAW_ROWS else n
        for start in range(0, n, step):
            row, place = block.row[start: start + step], block.place[start: start + step]
            for i, t in enumerate(trees):
                times = [draw(row[at: at + DRAW_ROWS], t) for at in range(0, len(row), DRAW_ROWS)]
                w[i] += np.bincount(place, np.concatenate(times), held).astype(w.dtype)
        return cls(n, block.y, block.x, w)

    @classmethod
    def merged(cls, parts: list["Weighed"]) -> "Weighed":
        if len(parts) == 1:
            return parts[0]
        y, x = np.concatenate([p.y for p in parts]), np.concatenate([p.x for p in parts])
        code, first = distinct(x, y)
        w = np.zeros((len(parts[0].w), len(first)), np.min_scalar_type(sum(int(p.w.max(initial=0)) for p in parts)))
        start = 0
        for p in parts:
            w[:, code[start: start + len(p.y)]] += p.w  # the rows of a part differ
            start += len(p.y)
        return cls(sum(p.n for p in parts), y[first], x[first], w)

    @property
    def nbytes(self) -> int:
        return self.y.nbytes + self.x.nbytes + self.w.nbytes

    def records(self, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
        """Records of about `block_bytes` at most; weights of 0 and 1 take a bit."""
        step = max(1, block_bytes * len(self.y) // max(self.nbytes, 1))
        for start in range(0, len(self.y), step):
            y, x, w = self.y[start: start + step], self.x[start: start + step], self.w[:, start: start + step]
            bits = 1 if w.max(initial=0) <= 1 else 8 * w.itemsize
            w = np.packbits(w.astype(np.uint8), axis=1) if bits == 1 else w
            sizes = [pa.array([0 if start else self.n]), pa.array([len(y)]), pa.array([bits], pa.int32())]
            yield pa.RecordBatch.from_arrays([*sizes, *(pa.array([v.tobytes()], pa.binary()) for v in (y, x, w))],
                                             names=[f.split()[0] for f in WEIGHED_KINDS.split(", ")])


def in_blocks(parts: Iterator, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """Blocks, or weighed ones, put together: equal rows become one, until the rows that differ fill about half a block."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= block_bytes:
            held = [type(part).merged(held)]
            size = held[0].nbytes
            if 2 * size >= block_bytes:
                yield held[0]
                held, size = [], 0
    if held:
        yield type(held[0]).merged(held)


def packed(rows: DataFrame, y_kind, code: Callable | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored blocks of rows (number, label, array of doubles); `code` makes other numbers of the matrix of values.

    Columns `n` (rows), `width` (values of a row), `last` (largest label) are for aggregates, the others for `blocks`.
    """
    def parts(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield Block.of_rows(b.column(0).to_numpy(), b.column(1).to_numpy().astype(y_kind), code(x) if code else x)

    def run(batches):
        for block in in_blocks(parts(batches), block_bytes):
            yield block.record()

    return checkpointed(rows.mapInArrow(run, _KINDS))


def weighed(batches, y_kind, x_kind=np.float64) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Callable]]:
    """(record, `y`, `x`, function from the place of a tree to its weights) of every weighed block of a task."""
    for b in batches:
        for i in range(b.num_rows):
            record = b.slice(i, 1)
            held, bits = record.column("held")[0].as_py(), record.column("bits")[0].as_py()
            y, x, w = (np.frombuffer(record.column(k)[0].as_buffer(), kind) for k, kind in (("y", y_kind), ("x", x_kind), ("w", np.uint8)))
            size = -(-held * bits // 8)

            def weights(place, w=w, held=held, bits=bits, size=size):
                own = w[place * size: (place + 1) * size]
                return np.unpackbits(own, count=held) if bits == 1 else own.view(f"u{bits // 8}")

            yield record, y, x.reshape(held, -1), weights


def looked_up(x: np.ndarray, known: dict, most: int, f: Callable) -> np.ndarray:
    """`f` of every row of a matrix, worked out once per distinct row; `known` keeps up to `most` of them from call to call."""
    code, first = distinct(x, np.zeros(len(x)))
    if 2 * len(first) > len(x) and not known:
        return f(x)
    rows = np.ascontiguousarray(x[first])
    raw, size = rows.tobytes(), rows.shape[1] * rows.itemsize
    keys = [raw[i * size: (i + 1) * size] for i in range(len(rows))]
    new = [i for i, k in enumerate(keys) if k not in known]
    own = dict(zip((keys[i] for i in new), f(rows[new]))) if new else {}
    found = np.array([own[k] if k in own else known[k] for k in keys])
    for k, v in own.items():
        if len(known) >= most:
            break
        known[k] = v
    return found[code]


def blocks(batches, y_kind, x_kind=np.float64) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The blocks of a task, each with its record."""
    for b in batches:
        for i in range(b.num_rows):
            record = b.slice(i, 1)
            row, place, y, x = (np.frombuffer(record.column(k)[0].as_buffer(), kind)
                                for k, kind in zip(range(3, 7), (np.int64, np.int32, y_kind, x_kind)))
            yield record, Block(row, place, y, x.reshape(len(y), -1))


def counted(stored: DataFrame, width: int, y_kind) -> DataFrame:
    """Columns x0, x1, ... of the distinct rows of blocks of doubles, and `n`, the number of their rows."""
    names = [*(f"x{i}" for i in range(width)), "n"]

    def run(batches):
        for _, block in blocks(batches, y_kind):
            n = np.bincount(block.place, minlength=len(block.y))
            for start in range(0, len(n), 1 << 16):
                x = block.x[start: start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in x.T), pa.array(n[start: start + (1 << 16)])], names=names)

    return stored.mapInArrow(run, ", ".join([*(f"{c} double" for c in names[:-1]), "n long"]))


def unpacked(stored: DataFrame, width: int, y_kind) -> DataFrame:
    """Columns x0, x1, ... of all rows of blocks of doubles."""
    names = [f"x{i}" for i in range(width)]

    def run(batches):
        for _, block in blocks(batches, y_kind):
            for start in range(0, len(block.place), 1 << 16):
                x = block.x[block.place[start: start + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=names)

    return stored.mapInArrow(run, ", ".join(f"{c} double" for c in names))
