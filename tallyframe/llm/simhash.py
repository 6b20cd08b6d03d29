"""SimHash fingerprints and near duplicates by bit-sliced comparison.

Fingerprints within the radius agree on at least `blocks - radius` of their `blocks` bit blocks, so they meet in a bucket
of the rows that share these blocks. In a bucket the fingerprints are compared as bit planes: plane b holds bit b of 64
fingerprints per machine word, two planes at a time go into vertical carry-save counters, and words whose 64 lanes have
all passed the radius are dropped. Buckets beyond TILE rows are cut into parts that meet pairwise in tiles.
"""

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, documents, forget_worker_state, packed, sized, stored, utf8
from tallyframe.llm.components import components
from tallyframe.llm.registry import query
from tallyframe.session import quoted

SHINGLE = 3
RADIUS = 3
TILE = 8192
SMALL_GROUP = 64
# Planes that are added before words beyond the radius are dropped, again and again.
PLANES_PER_LOOK = 8
HASHES_PER_LOOK = 1 << 16


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: bit set where more than half of its shingles' XXH64 (seed 42) have it set.

    Letters A-Z are lower-cased, words end at ASCII white space, repeated shingles count again. Fewer words than the
    shingle length are one shingle, no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, 42)
    starts = [0, *ends[:len(words) - shingle]]
    votes, n = np.zeros(64, np.int64), len(starts)
    cuts = zip(starts, ends[shingle - 1:])
    while part := [digest(line[a:b - 1], 42) for a, b in itertools.islice(cuts, HASHES_PER_LOOK)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keys: list[str], text: str, shingle: int = SHINGLE) -> DataFrame:
    """(keys, fp: long) for every row; a null text counts as empty, keys may be null or repeated."""
    def run(batches):
        forget_worker_state()
        for b in batches:
            fps = [simhash(t, shingle) for t in utf8(b.column(len(keys)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(np.array(fps, np.uint64).view(np.int64))],
                                             names=[*keys, "fp"])

    own = bounded_batches(df).select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[:-1])
    return own.mapInArrow(run, f"{schema}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of a row's words is the row's bit of fingerprint i. Lanes past the end are 0."""
    lanes = np.zeros((-(-len(fps) // 64) * 64, 8), np.uint8)
    lanes[:len(fps)] = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(lanes, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _within(planes, radius: int) -> np.ndarray:
    """Words whose set bits mark the lanes with at most `radius` set planes. `planes(b, live)` gives plane b, flat, at
    the words `live` (None: all)."""
    first = planes(0, None)
    size, live, digits = len(first), None, radius.bit_length()
    counts, over = [np.zeros(size, np.uint64) for _ in range(digits)], np.zeros(size, np.uint64)

    def carry(word, digit):
        nonlocal over
        for d in range(digit, digits):
            counts[d], word = counts[d] ^ word, counts[d] & word
        over |= word

    for b in range(0, 64, 2):
        x, y = first if b == 0 else planes(b, live), planes(b + 1, live)
        half = counts[0] ^ x
        word = (counts[0] & x) | (half & y)  # full adder: the counter's lowest digit and two planes
        counts[0] = half ^ y
        carry(word, 1)
        if (b + 2) % PLANES_PER_LOOK == 0:
            beyond = over | _above(counts, radius)
            keep = np.flatnonzero(~beyond)
            if len(keep) < 0.75 * len(beyond):
                live = keep if live is None else live[keep]
                counts, over = [c[keep] for c in counts], over[keep]
                if not len(live):
                    break
    found = np.zeros(size, np.uint64)
    last = ~(over | _above(counts, radius))
    if live is None:
        return last
    found[live] = last
    return found


def _above(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds `radius`."""
    above, equal = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for d in reversed(range(len(counts))):
        if radius >> d & 1:
            equal = equal & counts[d]
        else:
            above = above | (equal & counts[d])
            equal = equal & ~counts[d]
    return above


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] differ in at most `radius` bits."""
    if not len(a):
        return np.zeros(0, bool)
    xor = bit_planes(a ^ b)
    words = _within(lambda p, live: xor[p] if live is None else xor[p][live], radius)
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:len(a)].astype(bool)


def near_block(queries: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """Whether each fingerprint of `block` is within `radius` of any of `queries`."""
    planes = bit_planes(block)
    width, hit = planes.shape[1], np.zeros(planes.shape[1], np.uint64)
    step = max(1, (1 << 18) // width)
    for at in range(0, len(queries), step):
        q = queries[at:at + step]

        def plane(p, live, q=q):
            flip = (np.uint64(0) - (q >> np.uint64(p) & np.uint64(1)))
            if live is None:
                return (planes[p][None, :] ^ flip[:, None]).ravel()
            return planes[p][live % width] ^ flip[live // width]

        hit |= np.bitwise_or.reduce(_within(plane, radius).reshape(len(q), width), axis=0)
    return np.unpackbits(hit.view(np.uint8), bitorder="little")[:len(block)].astype(bool)


def group_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars (member, centre) that span the components of one group of distinct fingerprints."""
    left, links = fps, []
    while len(left) > 1:
        centre, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = near_block(front, left, radius)
            front, left = left[near], left[~near]
            links += [(int(f), int(centre)) for f in front]
    return links


def _link_rows(batches, radius: int):
    """Links of the rows (tile, fp) of a partition, sorted by tile; a tile may go on in the next batch."""
    rest_t, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in itertools.chain(batches, [None]):
        if b is None:
            t, f, rest_t = rest_t, rest_f, rest_t[:0]
        else:
            t = np.concatenate([rest_t, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.flatnonzero(t[1:] != t[:-1])[-1]) + 1 if len(t) and t[0] != t[-1] else 0
            rest_t, rest_f, t, f = t[cut:], f[cut:], t[:cut], f[:cut]
        if not len(t):
            continue
        edges = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
        sizes = np.diff(edges)
        links = [x for a, n in zip(edges[:-1], sizes) if n > SMALL_GROUP for x in group_links(f[a:a + n], radius)]
        u, v = (np.array(x, np.uint64) for x in zip(*links)) if links else (np.zeros(0, np.uint64),) * 2
        room = np.repeat(np.where(sizes > SMALL_GROUP, 0, edges[1:]), sizes)  # end of each row's group
        for shift in range(1, SMALL_GROUP):
            i = np.flatnonzero(np.arange(len(f)) + shift < room)
            if not len(i):
                break
            i = i[pairs_within(f[i], f[i + shift], radius)]
            u, v = np.r_[u, f[i + shift]], np.r_[v, f[i]]
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def bucket_masks(radius: int, blocks: int) -> list[int]:
    """Bits that must agree, one signed mask for every choice of `blocks - radius` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, radius: int) -> int:
    """Fewest blocks whose buckets hold about 256 random fingerprints or less; any number finds the same links."""
    for blocks in range(radius + 1, 3 * radius + 4):
        if rows <= 256 * 2 ** (64 * (blocks - radius) // blocks) or comb(blocks, radius) > 100:
            return blocks
    return 3 * radius + 3


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints `fp` that chains of steps of at most `radius` bits connect."""
    masks = bucket_masks(radius, blocks or blocks_for(distinct.count(), radius))
    posts = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "k"))
    hot = stored(posts.groupBy("c", "k").count().where(F.col("count") > TILE)
                 .select("c", "k", F.ceil(F.col("count") / TILE).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    tiles = posts.join(sized(hot), ["c", "k"], "left").select(
        "fp", "c", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    tile = F.xxhash64("c", "k", F.least("own", "other"), F.greatest("own", "other"))
    # Tiles whose hashes meet are compared as one, which adds comparisons but no link beyond the radius.
    spread = tiles.select(tile.alias("tile"), "fp").repartition("tile").sortWithinPartitions("tile")
    return spread.mapInArrow(lambda batches: _link_rows(batches, radius), "u long, v long").distinct()


def near_duplicates(fps: DataFrame, key: str, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Add component_id to rows (key, fp, ...): the least key that fingerprints linked at `radius` bits or fewer reach.

    Equal fingerprints are one node, so copies cost nothing. Null keys take part but lose against any other key; a
    component with no other key has a null id. An empty table stays empty. `fps` should be stored.
    """
    distinct = stored(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = stored(components(links(distinct.select("fp"), radius, blocks)).withColumnRenamed("node", "fp"))
    linked = distinct.join(sized(roots), "fp")
    named = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stored(roots.join(sized(named), "root").select("fp", "component_id"))
    alone = distinct.join(sized(named.select("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return fps.join(stored(alone.union(named)), "fp")


def drop_near_duplicates(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Keep one row of every component: the one with the least key (null last), then the least hash of key and text.

    Rows keep all their columns, whatever their names and types. Of rows equal in key and text one is kept, whichever; an
    empty table stays empty.
    """
    rows = packed(df, id=quoted(key), text=quoted(text)).withColumn("row", F.xxhash64("id", "text"))
    fps = stored(fingerprints(rows.select("id", "text", "row"), ["id", "row"], "text", shingle))
    grouped = stored(near_duplicates(fps.withColumn("node", F.col("fp")), "fp", radius))
    order = F.struct(F.col("id").isNull(), "id", "row")
    kept = grouped.groupBy("component_id").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"))
    times = grouped.groupBy("row").count()
    kept = stored(kept.join(times, "row").select(F.col("row").alias("row"), "count"))
    rows = rows.select("own", "row")
    once = rows.join(sized(kept.where("count = 1").select("row")), "row", "left_semi").select("own")
    more = rows.join(sized(kept.where("count > 1").select("row")), "row", "left_semi").groupBy("row").agg(F.any_value("own").alias("own"))
    return once.union(more.select("own")).select(*[F.col("own").getField(c).alias(c) for c in df.columns])


@query()
def op1_simhash_near_dedup(spark, folder):
    fps = stored(fingerprints(documents(spark, folder), ["doc_id"], "text"))
    found = near_duplicates(fps, "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
