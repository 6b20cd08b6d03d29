"""Merkle manifest of a dataset: rows are leaves of a tree per group, the trees' roots are leaves of one tree above them.

Three consecutive nodes become one, level by level. Leaves are numbered in order by ranges, and a superblock is 3 ** LEVELS
consecutive nodes of one tree (small trees share one). Going up, every superblock sends the single node above it; a table
of these is the next tier, again cut into superblocks, until each tree is one node. Going down, the nodes of a tier and the
outer nodes that their superblocks need (the siblings on the way to the root) are cogrouped by superblock: one call builds
the local levels again, joins the proofs and folds the leaves. A superblock is bounded, so no tree is held by a task.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, sized, stored
from tallyframe.llm.registry import query
from tallyframe.session import quoted

WAYS = 3
# Levels inside a superblock: 3 ** 8 = 6,561 nodes.
LEVELS = 8
RANGE_ROWS = 200_000


def digest(parts: list[Column]) -> Column:
    """Hash of one row: every part as `-` if null, else its UTF-8 length, a colon and its text."""
    coded = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-"))
             for p in parts]
    return F.sha2(F.concat(*coded), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Manifest:
    """Stored tables of a dataset's trees. `tiers` and `top`: (tree, size, place, node) from the leaves upward; `kept` has the
    names under which `rows` holds the kept columns."""

    rows: DataFrame
    kept: dict[str, str]
    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    levels: int


def in_order(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add `tree` (0, 1, ... by `group`, null first), `place` (gapless from 0 within the tree) and `size` of the tree.

    Rows are cut into ranges of (group, order), and the places of a range start after those of the earlier ones. `df`
    must be stored and hold a number `_tie` per row, so that also equal rows spread over ranges. A group may hold most rows.
    """
    n = df.count()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(math.ceil(n / RANGE_ROWS), min(least, math.ceil(n / 2_000)), 1)
    sort = [F.asc_nulls_first(c) for c in (group, *order, "_tie")]
    shift = 1 << 33  # monotonically_increasing_id holds the partition above this bit
    rows = stored(df.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort)
                  .withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_range": F.floor(F.col("_at") / shift), "_own": F.col("_at") % shift}).drop("_at")
    runs = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_own").alias("_first"))
    of_group = Window.partitionBy(group).orderBy("_range")
    runs = runs.withColumns({
        "_before": F.coalesce(F.sum("_n").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "size": F.sum("_n").over(Window.partitionBy(group))})
    fresh = F.when(F.col("_before") == 0, 1).otherwise(0)
    runs = runs.withColumn("_nth", F.sum(fresh).over(
        Window.partitionBy("_range").orderBy(F.asc_nulls_first(group)).rowsBetween(Window.unboundedPreceding, 0)))
    runs = stored(runs)
    # One row per range: trees that start in earlier ranges.
    starts = runs.groupBy("_range").agg(F.max("_nth").alias("_new"))
    starts = starts.select("_range", F.coalesce(F.sum("_new").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    # A run that continues a group counts no fresh tree, so the last one that started before it is its own.
    runs = stored(runs.join(sized(starts), "_range").select(
        F.col(group).alias("_group"), F.col("_range").alias("_of"), "size", (F.col("_before") - F.col("_first")).alias("_shift"),
        (F.col("_earlier") + F.col("_nth") - 1).alias("tree")))
    joined = rows.join(sized(runs), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("place", F.col("_own") + F.col("_shift")).drop("_group", "_of", "_range", "_own", "_shift", "_tie")


def _superblocks(tier: DataFrame, levels: int, rows: int) -> DataFrame:
    """Add the superblock (pile, block) of every node; trees of one superblock or less are piled up by a hash."""
    block = WAYS ** levels
    small = F.col("size") <= block
    piles = max(1, math.ceil(rows / block))
    return tier.withColumns({
        "pile": F.when(small, -1 - F.pmod(F.xxhash64("tree"), F.lit(piles))).otherwise(F.col("tree")),
        "block": F.when(small, F.lit(0)).otherwise(F.floor(F.col("place") / block)).cast("long")})


def _local(nodes: list[str], size: int, levels: int) -> list[list[str]]:
    """Levels of a superblock from its nodes up: to the root of a tree that fits, else all `levels`."""
    whole = size <= WAYS ** levels
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        last = out[-1]
        out.append([_h("".join(last[i:i + WAYS])) for i in range(0, len(last), WAYS)])
    return out


def _trees(pdf: pd.DataFrame):
    """(tree, size, its rows in order) of every tree in a superblock."""
    pdf = pdf.sort_values(["tree", "place"], ignore_index=True)
    tree = pdf["tree"].to_numpy()
    cuts = np.r_[0, np.flatnonzero(tree[1:] != tree[:-1]) + 1, len(pdf)] if len(pdf) else []
    for a, z in zip(cuts, cuts[1:]):
        yield int(tree[a]), int(pdf["size"].iat[a]), pdf.iloc[a:z]


def _reduce(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    block = WAYS ** levels
    return pd.DataFrame([
        (tree, -(-size // block), int(rows["place"].iat[0]) // block, _local(rows["node"].tolist(), size, levels)[-1][0])
        for tree, size, rows in _trees(pdf)], columns=["tree", "size", "place", "node"])


def _up(first: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of the trees of `first`, and a row (tree, node) for the root of each."""
    tiers, roots = [first], None
    up = "tree long, size long, place long, node string"
    while True:
        tier = tiers[-1]
        above = stored(_superblocks(tier.select("tree", "size", "place", "node"), levels, tier.count())
                       .groupBy("pile", "block").applyInPandas(lambda nodes: _reduce(nodes, levels), up))
        done = above.where("size = 1").select("tree", "node")
        roots = done if roots is None else roots.unionByName(done)
        rest = above.where("size > 1")
        if rest.isEmpty():
            return tiers, roots
        tiers.append(rest)


def build(df: DataFrame, group: str, order: list[str], node: str, keep: list[str], levels: int = LEVELS) -> Manifest:
    """Trees over the rows of `df`: one per `group` (null is a group, the first), its leaves `node` ascending by `order`.

    Groups are ordered bytewise, nulls first. Rows equal in `order` follow their leaf, so equal rows may swap places without a
    change. The columns `keep` are stored with the leaves under names of their own, so names can't clash; others are not
    read. An empty table has no root. A tree of one leaf is that leaf.
    """
    placed, kept = [f"order{i}" for i in range(len(order))], {c: f"kept{i}" for i, c in enumerate(keep)}
    own = stored(df.select(
        quoted(group).alias("group"), *[quoted(c).alias(n) for c, n in zip(order, placed)], quoted(node).alias("node"),
        *[quoted(c).alias(n) for c, n in kept.items()], F.monotonically_increasing_id().alias("_tie")))
    rows = in_order(own, "group", [*placed, "node"]).drop(*placed)
    if own.isEmpty():
        return Manifest(rows, kept, [], [], None, levels)
    tiers, roots = _up(rows, levels)
    roots = stored(roots)
    n = roots.count()
    top, last = _up(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"),
                                 F.col("tree").alias("place"), "node"), levels)
    return Manifest(rows, kept, tiers, top, last.first()["node"], levels)


def _steps(path: str) -> list[tuple[str, ...]]:
    return [tuple(step.split(".")) for step in path.split("|")] if path else []


def _beside(level: list[str]) -> list[tuple[str, str]]:
    """For every node of a level, the siblings left and right of it in its run."""
    return [("".join(level[i - i % WAYS:i]), "".join(level[i + 1:i - i % WAYS + WAYS])) for i in range(len(level))]


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int):
    """(tree, rows, outer row, function of a row's number to its path) of every tree in a superblock."""
    outer = {t: (p, s) for t, p, s in zip(outer["tree"].tolist(), outer["path"], outer["subroot"])}
    for tree, size, rows in _trees(nodes):
        beside = [_beside(level) for level in _local(rows["node"].tolist(), size, levels)[:-1]]
        path, subroot = outer[tree]
        above = _steps(path)
        yield tree, rows, subroot, lambda i, beside=beside, above=above: [
            *(level[i // WAYS ** j] for j, level in enumerate(beside)), *above]


def _widen(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The path to the root from every node of a tier, for the superblocks below it."""
    out = []
    for tree, rows, subroot, path in _paths(nodes, outer, levels):
        for i, (place, node) in enumerate(zip(rows["place"].tolist(), rows["node"])):
            out.append((tree, place, node, "|".join(".".join(step) for step in path(i)), subroot))
    return pd.DataFrame(out, columns=["tree", "place", "node", "path", "subroot"])


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for left, right in path:
        leaf = _h(left + leaf + right)
    return leaf


def _finish(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int, keys: list[str], paths: bool) -> pd.DataFrame:
    done = []
    for _, rows, subroot, path in _paths(nodes, outer, levels):
        out = rows[keys].copy()
        ways = [path(i) for i in range(len(rows))]
        out["leaf"], out["subroot"] = rows["node"], subroot
        out["proof_sha256"] = [_h("".join(left + right for left, right in way)) for way in ways]
        out["folded_root"] = [fold(leaf, way) for leaf, way in zip(rows["_check"], ways)]
        if paths:
            out["path"] = ["|".join(".".join(step) for step in way) for way in ways]
        done.append(out)
    columns = [*keys, "leaf", "subroot", "proof_sha256", "folded_root", *(["path"] if paths else [])]
    return pd.concat(done)[columns] if done else pd.DataFrame({c: pd.Series(dtype=str) for c in columns})


def _with_outer(tier: DataFrame, outer: DataFrame, levels: int):
    rows = tier.count()
    sizes = _superblocks(tier, levels, rows)
    # Aliases give the columns new identities: both sides may stem from one table.
    outer = outer.select(*[F.col(c).alias(c) for c in ("tree", "size", "path", "subroot")], (F.col("block") * WAYS ** levels).alias("place"))
    wanted = _superblocks(outer, levels, rows)
    return sizes.groupBy("pile", "block").cogroup(wanted.groupBy("pile", "block"))


def _down(tiers: list[DataFrame], roots: DataFrame, levels: int) -> DataFrame:
    """What the superblocks of the lowest of `tiers` need: (tree, size, block, path, subroot), from the paths of `roots`.

    `roots` holds (tree, path, subroot). A tree enters at the tier where it fits a superblock.
    """
    wanted = "tree long, place long, node string, path string, subroot string"
    below = None
    for i in reversed(range(len(tiers))):
        sizes = tiers[i].groupBy("tree").agg(F.max("size").alias("size"))
        small = sizes.where(F.col("size") <= WAYS ** levels).join(roots, "tree") \
            .select("tree", "size", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if below is not None:
            big = sizes.where(F.col("size") > WAYS ** levels).join(below, "tree") \
                .select("tree", "size", F.col("place").alias("block"), "path", "subroot")
            small = small.unionByName(big)
        if i == 0:
            return small
        below = stored(_with_outer(tiers[i], small, levels).applyInPandas(lambda nodes, outer: _widen(nodes, outer, levels), wanted))


def prove(manifest: Manifest, keys: list[str], check: str, paths: bool = False) -> DataFrame:
    """Per leaf: `keys`, leaf, subroot, root, proof_sha256 of all siblings on its way, and the fold of `check` along it.

    `check` is a kept column with the leaf as found now; `verified` says whether it leads to the root. With `paths`, column
    `path` has the siblings, a step `left.right` a level, joined by `|`. Keys are columns of simple types.
    """
    rows, kept, levels = manifest.rows, manifest.kept, manifest.levels
    kinds = dict(rows.dtypes)
    root = F.lit(manifest.root).cast("string")
    result = "leaf string, subroot string, proof_sha256 string, folded_root string" + (", path string" if paths else "")
    # Keys travel as text, since pandas has no nulls among integers.
    names = [f"key{i}" for i in range(len(keys))]
    if manifest.root is None:
        out = rows.select(*[F.col(kept[k]).cast("string").alias(n) for k, n in zip(keys, names)],
                          *[F.lit(None).cast("string").alias(c.split()[0]) for c in result.split(", ")]).limit(0)
    else:
        start = manifest.top[-1].groupBy("tree").agg(F.lit("").alias("path"), F.lit("").alias("subroot"))
        outer = _down(manifest.top, start, levels)
        paths_of_roots = stored(_with_outer(manifest.top[0], outer, levels).applyInPandas(
            lambda nodes, outer: _widen(nodes, outer, levels), "tree long, place long, node string, path string, subroot string"))
        roots = paths_of_roots.select(F.col("place").alias("tree"), "path", F.col("node").alias("subroot"))
        leaves = rows.select("tree", "size", "place", "node", F.col(kept[check]).alias("_check"),
                             *[F.col(kept[k]).cast("string").alias(n) for k, n in zip(keys, names)])
        outer = _down([leaves, *manifest.tiers[1:]], roots, levels)
        schema = ", ".join([*(f"{n} string" for n in names), result])
        out = _with_outer(leaves, outer, levels).applyInPandas(
            lambda nodes, outer: _finish(nodes, outer, levels, names, paths), schema)
    return out.select(*[F.col(n).cast(kinds[kept[k]]).alias(k) for k, n in zip(keys, names)], "leaf", "subroot", root.alias("root"),
                      "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *(["path"] if paths else []))


# Levels that the SQL unrolls: enough for 3 ** 12 leaves of a source, and as many sources.
_SQL_LEVELS = 12


def _sql() -> str:
    coded = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
                        for c in ("doc_id", "source", "lang", "n_chars"))
    part = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    cleared = "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END"
    steps = [f"""
bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c
  FROM range(256) t(i)),
bytes AS (SELECT list(c ORDER BY i) AS c FROM bits),
d AS (SELECT *, (SELECT xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: xor(a >> 8, bytes.c[xor(a % 256, x) + 1])), 4294967295) FROM bytes) % 2 = 0 AS even FROM documents),
l AS (SELECT doc_id, source, sha256({coded} || {part.format("text")}) AS leaf,
    sha256({coded} || {part.format(f"({cleared})")}) AS changed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
g0 AS (SELECT source AS tree, place, leaf AS node FROM r)"""]
    for name, others in (("g", "r"), ("t", "s")):
        for k in range(_SQL_LEVELS):
            steps.append(f"""
{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {name}{k}),
{name}{k + 1} AS (SELECT tree, place // 3 AS place, CASE WHEN max(size) = 1 THEN max(node)
    ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node FROM {name}{k}n GROUP BY tree, place // 3)""")
        if name == "g":
            steps.append(f"""
s AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS nth FROM g{_SQL_LEVELS}),
t0 AS (SELECT 0 AS tree, nth AS place, subroot AS node FROM s)""")
    steps.append("""
w0 AS (SELECT r.doc_id, r.leaf, r.changed AS h, r.place, r.source, '' AS proof FROM r)""")
    for k in range(2 * _SQL_LEVELS):
        level, of = (f"g{k}n", "n.tree IS NOT DISTINCT FROM w.source") if k < _SQL_LEVELS else (f"t{k - _SQL_LEVELS}n", "true")
        if k == _SQL_LEVELS:
            steps.append(f"""
w{k}x AS (SELECT w.doc_id, w.leaf, w.h, s.nth AS place, w.source, w.proof FROM w{k} w JOIN s ON s.source IS NOT DISTINCT FROM w.source)""")
        here = f"w{k}x" if k == _SQL_LEVELS else f"w{k}"
        steps.append(f"""
w{k + 1} AS (SELECT w.doc_id, w.leaf, w.source, w.place // 3 AS place,
    CASE WHEN max(n.size) = 1 THEN w.h ELSE sha256(coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (n.place < w.place), '') || w.h
      || coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (n.place > w.place), '')) END AS h,
    w.proof || coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (n.place <> w.place), '') AS proof
  FROM {here} w JOIN {level} n ON {of} AND n.place // 3 = w.place // 3 GROUP BY w.doc_id, w.leaf, w.source, w.place, w.h, w.proof)""")
    return "WITH " + ",".join(steps) + f"""
SELECT w.doc_id, w.leaf, s.subroot, t.node AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.node AS verified
FROM w{2 * _SQL_LEVELS} w JOIN s ON s.source IS NOT DISTINCT FROM w.source CROSS JOIN t{_SQL_LEVELS} t"""


@query(_sql())
def op11_merkle_manifest(spark, folder):
    docs = documents(spark, folder)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))) \
        .otherwise(F.col("text"))
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", digest([*plain, F.col("text")]).alias("original"),
                         digest([*plain, tampered]).alias("found"))
    return prove(build(leaves, "source", ["doc_id"], "original", ["doc_id", "found"]), ["doc_id"], "found")
