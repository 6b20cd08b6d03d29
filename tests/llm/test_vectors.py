import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import approximation, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, `a.b` int, _q int"


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def ranked(rows, own, vectors):
    """(score, id, place) of all other rows, best first; a null id last among equals."""
    found = [(product(vectors[own], vectors[j]), rows[j][0], j) for j in rows if j != own]
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def plain_rows(rows):
    rows = {i: r for i, r in enumerate(rows) if whole(r[1]) is not None}
    return rows, {i: whole(r[1]) for i, r in rows.items()}


def plain_top(rows, k=5):
    rows, vectors = plain_rows(rows)
    return Counter((rows[i][0], n, j, s) for i in rows if rows[i][0] is not None and rows[i][0] % 50 == 0
                   for n, (s, j, _) in enumerate(ranked(rows, i, vectors)[:k], 1))


def plain_negatives(rows):
    rows, vectors = plain_rows([(i, v, (c + 1) % 10 if c is not None and i is not None and i % 7 == 0 else c) for i, v, c in rows])
    rows = {i: r for i, r in rows.items() if r[2] is not None}
    out = Counter()
    for i in rows:
        if rows[i][0] is None or rows[i][0] % 100:
            continue
        order = ranked(rows, i, vectors)
        for score, p, _ in [x for x in order if rows[x[2]][2] == rows[i][2]][:5]:
            fit = [x for x in order if rows[x[2]][2] != rows[i][2] and 80 * score <= 100 * x[0] <= 100 * score]
            for n, (s, j, _) in enumerate(fit[:5], 1):
                out[rows[i][0], p, n, j, score, s] += 1
    return out


def made(kind, n=420, width=6):
    rnd = random.Random(kind)
    rows = []
    for i in range(n):
        v = [rnd.gauss(0.3, 0.4) for _ in range(width)]
        if kind == "ties":
            v = [float(round(x)) for x in v]
        if kind == "long":
            v = [x * 3e4 for x in v]
        if kind == "ragged":
            v = v[:rnd.randint(0, width)]
        rows.append((i, v, rnd.randint(0, 3)))
    rows += [rows[3]] * 60 + [rows[100]] * 9 + [(None, rows[5][1], 1)] * 2
    rows += [(500, None, 1), (600, [None] + [0.0] * (width - 1), 1), (700, [float("nan")] * width, 1), (800, [float("-inf")] * width, 1)]
    return rows + [(1000, [0.0] * width, None), (1100, [0.0] * width, 2)]


@pytest.fixture
def stored_rows(spark, tmp_path):
    def store(rows):
        full = [(*r, "clash", 1, 2, 3) for r in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)
    return store


@pytest.mark.parametrize("kind", ["plain", "ties", "long", "ragged"])
def test_queries_equal_brute_force(spark, stored_rows, kind):
    rows = made(kind)
    folder = stored_rows(rows)
    top = approximation.op13_exact_top_k(spark, folder).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in top) == plain_top(rows)
    mined = negatives.op12_hard_negatives(spark, folder).collect()
    assert Counter(tuple(r) for r in mined) == plain_negatives(rows)


def test_small_blocks_and_few_cells(spark, stored_rows):
    rows = made("blocks", 300)
    df = spark.read.parquet(f"{stored_rows(rows)}/embeddings.parquet")
    key = F.col("vec_id")
    top = approximation.top_k(df, key, "embedding", key % 50 == 0, cells=2, query_rows=3, block_rows=20).collect()
    assert Counter(tuple(r) for r in top) == plain_top(rows)
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = negatives.hard_negatives(df, key, "embedding", label, key % 100 == 0, query_rows=2, block_rows=25).collect()
    assert Counter(tuple(r) for r in mined) == plain_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [], 1), (50, [], 1), (100, [], 2)], [(0, None, None)],
                                  [(0, [0.5, 1.0], 1), (7, [0.5, 0.9], 0), (2, [0.25, 1.0], 2)]])
def test_few_rows(spark, stored_rows, rows):
    folder = stored_rows(rows)
    top = approximation.op13_exact_top_k(spark, folder).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in top) == plain_top(rows)
    assert Counter(tuple(r) for r in negatives.op12_hard_negatives(spark, folder).collect()) == plain_negatives(rows)


def test_vectors_too_long_for_a_long_are_an_error(spark, stored_rows):
    folder = stored_rows([(0, [1e30], 1), (1, [1.0], 1)])
    with pytest.raises(ValueError):
        approximation.op13_exact_top_k(spark, folder)


def test_residues_give_exact_signed_products():
    rng = np.random.default_rng(1)
    for most, width in ((1, 3), (300, 64), (2 ** 20, 200), (2 ** 27, 130)):
        a, b = (rng.integers(-most, most + 1, (n, width)) for n in (7, 9))
        bound = int(max((m.astype(object) ** 2).sum(1).max() for m in (a, b))) + 1
        moduli = negatives.primes(bound)
        left, right = negatives.Residues(a, moduli), negatives.Residues(b, moduli)
        assert (left.scores(right, slice(0, 7)) == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()
    assert len(negatives.primes(70_000)) == 2 and len(set(negatives.primes(2 ** 62))) == len(negatives.primes(2 ** 62))


def test_bounds_hold_for_every_pair(spark, stored_rows):
    df = spark.read.parquet(f"{stored_rows(made('bounds', 200))}/embeddings.parquet")
    rows, width, _ = approximation.whole_vectors(df, "embedding", 256.0, id=F.col("vec_id"))
    edges = approximation.marks(rows, width, 8)
    vectors = {r.row: np.array(r.v) for r in rows.collect()}
    cells = {r.row: np.frombuffer(r.cells, np.uint8) for r in approximation.approximate(rows, edges).collect()}
    assert cells.keys() == vectors.keys()
    dims = np.arange(width)
    for row, v in vectors.items():
        assert (edges[dims, cells[row]] <= v).all() and (v <= edges[dims, cells[row] + 1]).all()
