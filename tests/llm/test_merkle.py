import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import merkle
from tallyframe.llm.common import documents


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes):
    """Levels of a tree, and for every leaf the siblings of each level left and right."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(last[i:i + 3]) for i in range(0, len(last), 3)])
    ways = []
    for i in range(len(nodes)):
        way, at = [], i
        for level in levels[:-1]:
            run = range(at // 3 * 3, min(len(level), at // 3 * 3 + 3))
            way.append(([level[j] for j in run if j < at], [level[j] for j in run if j > at]))
            at //= 3
        ways.append(way)
    return levels[-1][0], ways


def plain_manifest(rows):
    """Result rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        found = r[4].replace("\n", "") if even and r[4] is not None else r[4]
        groups[r[1]].append(((r[0] is not None, r[0] or 0), plain_leaf(r), plain_leaf((*r[:4], found)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf for _, leaf, _, _ in sorted(groups[s])]) for s in names]
    root, top = plain_tree([t[0] for t in trees])
    out = Counter()
    for s, (subroot, ways), above in zip(names, trees, top):
        for (_, leaf, found, key), way in zip(sorted(groups[s]), ways):
            way, folded = way + above, found
            for left, right in way:
                folded = h([*left, folded, *right])
            out[key, leaf, subroot, root, h(x for l, r in way for x in l + r), folded, folded == root] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def found(df, levels):
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = df.withColumns({"original": merkle.digest([*plain, F.col("text")]), "found": merkle.digest([*plain, changed])})
    built = merkle.build(leaves, "source", ["doc_id"], "original", ["doc_id", "found"], levels)
    return Counter(tuple(r) for r in merkle.prove(built, ["doc_id"], "found").collect())


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in documents(spark, folder).select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in merkle.op11_merkle_manifest(spark, folder).collect()) == plain_manifest(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_several_tiers(spark, levels):
    """Superblocks of 3 or 9 nodes: a source with most rows, many tiny ones, a null one, repeated and null ids."""
    rnd = random.Random(5)
    rows = [(i, "hot", "en", i, f"line {i}\nnext") for i in range(200)]
    rows += [(rnd.randint(0, 40), rnd.choice([None, "é", "z", "Z", "a"]), None, None, rnd.choice([None, "", "\n", "x\ny"])) for _ in range(60)]
    rows += [(7, "copies", "de", 1, "same\n")] * 30 + [(None, "hot", "en", 1, "no id\n")] * 3 + [(i, f"own{i}", "en", 1, "t\n") for i in range(40)]
    assert found(table(spark, rows), levels) == plain_manifest(rows)


def test_one_row_and_no_row(spark):
    one = [(2, "s", None, 3, "a\nb")]
    assert found(table(spark, one), 8) == plain_manifest(one)
    assert found(table(spark, []), 8) == Counter()


def test_paths_prove_each_leaf_and_names_may_clash(spark):
    df = table(spark, [(i, f"s{i % 4}", "en", i, "t\n" * i) for i in range(50)])
    leaves = df.withColumns({"leaf": merkle.digest([F.col("doc_id"), F.col("text")]), "size": F.lit("x"), "path": F.lit(1),
                             "_group": F.lit(2), "a.b": F.lit(3), "pile": F.lit(1), "block": F.lit(1)})
    rows = merkle.prove(merkle.build(leaves, "source", ["doc_id"], "leaf", ["doc_id", "text", "a.b", "leaf"], 1), ["doc_id", "text", "a.b"], "leaf", paths=True).collect()
    assert len(rows) == 50 and all(r.verified and merkle.fold(r.leaf, merkle._steps(r.path)) == r.root for r in rows)
    assert {(r.doc_id, r.text) for r in rows} == {(i, "t\n" * i) for i in range(50)}
    assert len({r.path for r in rows}) == 50
