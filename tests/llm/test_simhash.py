import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tallyframe.llm import simhash as S
from tallyframe.llm.common import documents
from tallyframe.llm.components import components


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    """Least index that chains of near fingerprints reach, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 6])
def test_bit_planes_count_like_popcount(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**64, 500, np.uint64)
    b = a.copy()
    for _ in range(radius + 1):
        b ^= np.uint64(1) << rng.integers(0, 64, 500, np.uint64)
    assert (S.pairs_within(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()
    near = S.near_block(a[:70], np.r_[b, b ^ np.uint64(1)], radius)
    assert (near == [(np.bitwise_count(a[:70] ^ x) <= radius).any() for x in np.r_[b, b ^ np.uint64(1)]]).all()


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 4), (5, 4)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_lose_no_pair(spark, monkeypatch, blocks):
    """Chains, dense groups and buckets that are cut into tiles."""
    monkeypatch.setattr(S, "TILE", 40)
    rnd = random.Random(blocks)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for _ in range(6):
        seed = rnd.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rnd.sample(range(64), 3)) for _ in range(60)}
        for _ in range(30):
            seed ^= sum(1 << b for b in rnd.sample(range(64), 3))
            fps.add(seed)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "id long, fp long")
    got = {r.id: r.component_id for r in S.near_duplicates(df, "id", blocks=blocks).collect()}
    assert [got[i] for i in range(len(fps))] == plain_components(fps)


def test_query(spark, folder, docs):
    rows = S.op1_simhash_near_dedup(spark, folder).collect()
    fps = [plain_fingerprint(t) for _, t in docs]
    least = defaultdict(list)
    for (d, _), r in zip(docs, plain_components(fps)):
        least[r].append(d)
    expected = Counter((d, f"{f:016x}", min(x for x in least[r] if x is not None))
                       for (d, _), f, r in zip(docs, fps, plain_components(fps)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected


def test_one_document_of_each_group_stays(spark, folder, docs):
    kept = S.drop_near_duplicates(documents(spark, folder), "doc_id", "text")
    assert kept.columns == documents(spark, folder).columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = defaultdict(list)
    for (d, t), root in zip(docs, plain_components([plain_fingerprint(t) for _, t in docs])):
        groups[root].append((d is None, d, t))
    assert sum(rows.values()) == len(groups)
    for members in groups.values():
        first = min(m[:2] for m in members)
        assert sum(rows[d, t] for n, d, t in set(members) if (n, d) == first) == 1


def test_empty(spark, empty):
    assert S.op1_simhash_near_dedup(spark, empty).count() == 0
    assert S.drop_near_duplicates(documents(spark, empty), "doc_id", "text").count() == 0
