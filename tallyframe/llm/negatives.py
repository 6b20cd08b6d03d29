"""Hard negatives by exact scores in a residue number system.

Whole-number vectors are taken modulo a few primes so small that float32 products of the residues add up without rounding.
Each prime is one matrix product; the residues of a score then give the signed score back by Chinese remaindering (mixed
radix digits, so no product of the primes is ever formed). Anchors meet rows block by block: first the rows of their own
label, whose best are the positives, then all others, of which every block keeps the best below each positive's score.
Windows over what the blocks keep select the result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import stored
from tallyframe.llm.registry import query
from tallyframe.llm.vectors import BLOCK_ROWS, QUERY_ROWS, first, in_blocks, matrix, numbers, whole_vectors

# Components that are multiplied before residues are taken again, and the largest whole number float32 adds up to exactly.
CHUNK = 64
EXACT = 1 << 24
# Anchors whose scores against a block of rows are in memory at a time.
SLICE = 64


def primes(bound: int, chunk: int = CHUNK) -> list[int]:
    """Largest primes that keep a chunk's products exact, so many that their product tells -bound..bound apart."""
    out, product = [], 1
    p = 2 * int((EXACT / chunk) ** 0.5) + 1
    while product <= 2 * bound:
        p -= 1
        if (p // 2) ** 2 * chunk + p < EXACT and all(p % d for d in range(2, int(p ** 0.5) + 1)):
            out.append(p)
            product *= p
    return out


def _residue(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues -p//2..p//2 of whole numbers."""
    return (x + p // 2) % p - p // 2


def residue_products(a: np.ndarray, b: np.ndarray, p: int, chunk: int = CHUNK) -> np.ndarray:
    """Balanced residues of a @ b.T for balanced float32 residues a and b."""
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], chunk):
        total += a[:, at:at + chunk] @ b[:, at:at + chunk].T
        total -= np.float32(p) * np.rint(total / np.float32(p))
    return _residue(total.astype(np.int32), p)


def signed(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers with these balanced residues: digit i counts the product of the earlier moduli, all digits balanced."""
    digits, value, weight = [], 0, 1
    for i, (r, p) in enumerate(zip(residues, moduli)):
        digit = r.astype(np.int64)
        for d, q in zip(digits, moduli[:i]):
            digit = _residue((digit - d) * pow(q, -1, p), p)
        digits.append(digit)
        # Beyond 64 bits weights wrap around, and so does the sum: what is left is the value itself.
        value = value + digit * np.array(weight % (1 << 64), np.uint64).astype(np.int64)
        weight *= p
    return value


class Residues:
    """Vectors as float32 residues of each prime."""

    def __init__(self, vectors: np.ndarray, moduli: list[int]):
        self.moduli = moduli
        self.parts = [_residue(vectors, p).astype(np.float32) for p in moduli]

    def scores(self, other: "Residues", rows: slice) -> np.ndarray:
        """Exact inner products of `rows` with all vectors of `other`."""
        return signed([residue_products(a[rows], b, p) for a, b, p in zip(self.parts, other.parts, self.moduli)], self.moduli)


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def positives(anchors: DataFrame, rows: DataFrame, moduli: list[int], width: int, k: int,
              query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor, place, id, score): the first k other rows of every anchor's label, by score, ties by smaller id (null: last)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(left, right):
        found = []
        a, b = (Residues(matrix(t["v"], width), moduli) for t in (left, right))
        own, labels = left["row"].to_numpy(), left["label"].to_numpy()
        there, theirs = right["row"].to_numpy(), right["label"].to_numpy()
        ids, missing = numbers(right["id"])
        for at in range(0, len(own), SLICE):
            for i, scores in enumerate(a.scores(b, slice(at, at + SLICE)), at):
                for j in first(np.flatnonzero((theirs == labels[i]) & (there != own[i])), scores, ids, missing, k):
                    found.append((own[i], there[j], None if missing[j] else ids[j], scores[j]))
        return _table(found, ["anchor", "other", "id", "score"], kinds)

    buckets = max(1, -(-rows.count() // block_rows))
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets))  # few labels: one each; many: several share one
    best = in_blocks(anchors.withColumn("bucket", bucket), rows.withColumn("bucket", bucket), ["bucket"], run,
                     "anchor long, other long, id long, score long", query_rows, block_rows)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("anchor", "place", "id", "score")


def negatives(anchors: DataFrame, rows: DataFrame, moduli: list[int], width: int, k: int, share: tuple[int, int],
              query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor, below, rank, id, score): for every score in an anchor's array `below`, the first k rows of other labels whose
    score lies from `share` of it up to it."""
    part, whole = share
    kinds = [pa.int64()] * 5

    def run(left, right):
        found = []
        a, b = (Residues(matrix(t["v"], width), moduli) for t in (left, right))
        own, labels, below = left["row"].to_numpy(), left["label"].to_numpy(), left["below"].to_pylist()
        there, theirs = right["row"].to_numpy(), right["label"].to_numpy()
        ids, missing = numbers(right["id"])
        for at in range(0, len(own), SLICE):
            for i, scores in enumerate(a.scores(b, slice(at, at + SLICE)), at):
                other = theirs != labels[i]
                for top in below[i]:
                    least = -(-part * top // whole)
                    if least > top:
                        continue
                    for j in first(np.flatnonzero(other & (scores >= least) & (scores <= top)), scores, ids, missing, k):
                        found.append((own[i], top, there[j], None if missing[j] else ids[j], scores[j]))
        return _table(found, ["anchor", "below", "other", "id", "score"], kinds)

    best = in_blocks(anchors, rows, [], run, "anchor long, below long, other long, id long, score long", query_rows, block_rows)
    rank = F.row_number().over(Window.partitionBy("anchor", "below").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor", "below", "rank", "id", "score")


def hard_negatives(df: DataFrame, key: Column, vector: str, label: Column, anchor: Column, n_positives: int = 5,
                   n_negatives: int = 5, share: tuple[int, int] = (4, 5), scale: float = 256.0,
                   query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` is true.

    Scores are inner products of floor(scale * x). An anchor's positives are the best other rows of its label, its negatives
    rows of other labels that score from `share` (a fraction) of the positive's score up to that score. Higher scores come
    first, ties by smaller key, a null key last. Rows with a null label take no part, nor do those `whole_vectors` leaves
    out; `key` and `label` are integers. Rows that repeat are rows of their own: an anchor's copies may be its positives.
    Other columns of `df` are not read, whatever their names.
    """
    rows, width, norm = whole_vectors(df, vector, scale, id=key.cast("long"), label=label.cast("long"),
                                      is_anchor=F.coalesce(anchor, F.lit(False)))
    rows = rows.where("label IS NOT NULL")
    moduli = primes(int(norm) + 1)
    anchors = rows.where("is_anchor").select("row", "id", "label", "v")
    rows = rows.select("row", "id", "label", "v")
    chosen = stored(positives(anchors, rows, moduli, width, n_positives, query_rows, block_rows))
    below = chosen.groupBy("anchor").agg(F.collect_set("score").alias("below"))  # at most n_positives numbers
    wanted = anchors.join(below, F.col("row") == F.col("anchor")).select("row", "label", "v", "below")
    best = negatives(wanted, rows, moduli, width, n_negatives, share, query_rows, block_rows)
    named = chosen.join(anchors.select("row", F.col("id").alias("anchor_id")), F.col("anchor") == F.col("row")).select(
        "anchor", "anchor_id", F.col("id").alias("positive_id"), "place", F.col("score").alias("positive_score"))
    return named.join(best, (named["anchor"] == best["anchor"]) & (named["positive_score"] == best["below"])).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


SCORES_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
"""
_SQL = f"""WITH {SCORES_SQL}
r AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
f AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT f.anchor_id, f.positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, f.positive_score, n.score AS negative_score
FROM f JOIN p n ON n.anchor_id = f.anchor_id AND NOT n.same
  AND 80 * f.positive_score <= 100 * n.score AND 100 * n.score <= 100 * f.positive_score
WINDOW w AS (PARTITION BY f.anchor_id, f.positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5"""


@query(_SQL)
def op12_hard_negatives(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    key = F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, key, "embedding", label, key % 100 == 0)
