"""Best-fit packing by patterns: repeat counts of few-piece length patterns are fitted to the histogram of lengths.

Only the histogram (a number per length up to the sequence length) reaches the driver. There all patterns of one, two and
three lengths that fill a sequence are fitted by non-negative least squares, the counts are rounded down, and the
histogram that remains is packed best fit, largest first, many equal pieces at a time. The resulting plan says for every
length which ranks of its pieces go to which sequences; the pieces then find their places on the executors.
"""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, documents, forget_worker_state, numbered, stored
from tallyframe.llm.registry import query
from tallyframe.llm.words import id_blocks, library_ids
from tallyframe.session import quoted

BYTES = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 0
ROUNDS = 300
# Text that is cut into words at a time: a worker's memory grows with it, beside a JVM that has reached its full heap.
BLOCK_BYTES = 2 << 20


def pieces(df: DataFrame, keys: list[str], text: str, path: str = BYTES, end_id: int = END_ID,
           capacity: int = CAPACITY, digests: bool = False) -> DataFrame:
    """(keys, piece, start, length, ids) of all documents: ids of the whole text and `end_id`, longer ones cut.

    Ids are little-endian unsigned 32-bit integers in a binary column; with `digests` there is the CRC-32 of these bytes
    instead, column ids_crc32. Pieces of a cut document have `capacity` ids but for the first, which takes the rest. A null text
    is empty, so its one piece is the end id. Rows with the same keys each give their own pieces. Other columns are not read.
    """
    names = [f"key{i}" for i in range(len(keys))]

    def run(batches):
        forget_worker_state()
        for b in batches:
            for at, ids, bounds in id_blocks(library_ids(path), b.column(len(keys)), end_id, BLOCK_BYTES):
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                source = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rest = sizes - (n - 1) * capacity  # what the first piece takes
                start = np.where(piece > 0, rest[source] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, rest[source])
                cuts = np.r_[bounds[:-1][source] + start, bounds[-1:]] * 4
                data = ids.astype("<u4").tobytes()
                if digests:
                    view, edges = memoryview(data), cuts.tolist()
                    last = pa.array([zlib.crc32(view[a:z]) for a, z in zip(edges, edges[1:])], pa.int64())
                else:
                    last = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(source + at)) for c in b.columns[:len(keys)]], pa.array(piece, pa.int32()),
                     pa.array(start), pa.array(length), last],
                    names=[*names, "piece", "start", "length", "ids_crc32" if digests else "ids"])

    own = bounded_batches(df).select(*[quoted(k).alias(n) for k, n in zip(keys, names)], quoted(text).alias("text"))
    kinds = ", ".join(f"{n} {t}" for n, t in own.dtypes[:-1])
    found = own.mapInArrow(run, f"{kinds}, piece int, start long, length long, " + ("ids_crc32 long" if digests else "ids binary"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *found.columns[len(keys):])


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths `present` that add up to `capacity`, as rows (0: no piece)."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    rows = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    ok = np.flatnonzero(have[:capacity])
    pair = ok[(2 * ok >= capacity) & have[capacity - ok]]
    rows.append(np.stack([pair, capacity - pair, 0 * pair], 1))
    for a in ok:
        b = ok[(ok <= a) & (2 * ok >= capacity - a) & (ok < capacity - a)]
        b = b[have[capacity - a - b]]
        rows.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(rows).astype(np.int64)


def fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x of the patterns with least ||Ax - histogram||^2, by accelerated projected gradient.

    A's columns count the lengths of a pattern. Steps are scaled per pattern by the sum of its rows' sums, a bound of the
    curvature, so short and frequent lengths don't slow the others down. The zero that pads a pattern has no weight.
    """
    size = len(histogram)
    weight = (rows > 0).astype(float)
    sums = np.bincount(rows.ravel(), minlength=size).astype(float)
    scale = 1.0 / np.maximum((sums[rows] * weight).sum(1), 1.0)
    x = np.zeros(len(rows))
    y, momentum = x, 1.0
    for _ in range(rounds):
        miss = np.bincount(rows.ravel(), weights=np.repeat(y, 3), minlength=size) - histogram
        miss[0] = 0
        new = np.maximum(0, y - scale * miss[rows].sum(1))
        step = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        y, x, momentum = new + (momentum - 1) / step * (new - x), new, step
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places (length, first rank, end rank, first sequence, offset): ranks r of a length go to sequence first + r - rank.

    Fitted patterns come first, most repeated first and never more often than the histogram allows; what remains goes
    best fit, largest first, into the fullest sequences with room. The work depends on the capacity, not on the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used, places, sequences = np.zeros(capacity + 1, np.int64), [], 0

    def put(length, n, sequence, offset):
        places.append((int(length), int(used[length]), int(used[length] + n), int(sequence), int(offset)))
        used[length] += n
        left[length] -= n

    rows = patterns(np.flatnonzero(left), capacity)
    if len(rows):
        counts = fit(rows, left.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            n = int(np.floor(counts[i] + 1e-6))
            if n < 1:
                break
            lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
            n = min(n, int((left[lengths] // times).min()))
            offset = 0
            for length in rows[i][rows[i] > 0] if n > 0 else ():
                put(length, n, sequences, offset)
                offset += length
            sequences += max(n, 0)
    room = [[] for _ in range(capacity + 1)]  # by free ids: runs (first sequence, sequences)
    for length in range(capacity, 0, -1):
        n = left[length]
        gap = length
        while n > 0 and gap < capacity:
            while n > 0 and room[gap]:
                first, count = room[gap].pop()
                take = min(n, count)
                put(length, take, first, capacity - gap)
                room[gap - length].append((first, take))
                if take < count:
                    room[gap].append((first + take, count - take))
                n -= take
            gap += 1
        if n > 0:
            each = capacity // length
            full, rest = divmod(int(n), each)
            for count, repeat in ((full, each), (1, rest)):
                if count and repeat:
                    for k in range(repeat):
                        put(length, count, sequences, k * length)
                    room[capacity - repeat * length].append((sequences, count))
                    sequences += count
    return places


def pack(df: DataFrame, length: str, spread: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of pieces with a `length` from 1 to `capacity`.

    Rows are numbered within their length by a hash of `spread`, also where one length holds most rows, and look their
    rank up in the plan, whose size depends on the capacity alone. `df` should be stored; columns sequence_id and offset
    are replaced. Repeated rows get places of their own, an empty table stays empty.
    """
    df = df.drop("sequence_id", "offset")
    counts = {int(r[0]): r[1] for r in df.groupBy(length).count().collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    total = max(counts.values(), default=0) + 1
    keys = places[:, 0] * total + places[:, 1]
    ranked = numbered(df, [length], spread, "_rank", sum(counts.values()))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        rank = ranks.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, lengths.to_numpy(zero_copy_only=False).astype(np.int64) * total + rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(places[at, 3] + rank - places[at, 1]), pa.array(places[at, 4])],
                                          ["sequence_id", "offset"])

    found = ranked.withColumn("_place", place(F.col(length), F.col("_rank")))
    return found.withColumns({"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")}) \
        .drop("_rank", "_place")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids: binary) from packed pieces (sequence_id, offset, ids); no group exceeds the capacity in ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with the CRC-32 of their ids, packed."""
    cut = pieces(docs, ["doc_id"], "text", digests=True)
    return pack(stored(cut), "length", ["doc_id", "piece", "ids_crc32"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op10_best_fit_packing(spark, folder):
    return packed_digests(documents(spark, folder))
