"""k-means over a group table, its quality measures and the choice of k."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.expressions import number
from tallyframe.operators.groups import best_by
from tallyframe.session import checkpointed, quoted

BLOCK_ROWS = 2_000
# Pairs of blocks that a task compares, and points from which all cores are to hold some.
TASK_PAIRS = 8
SPREAD_ROWS = 20_000
# Rounds of candidates for the starts, candidates a round for every centre of the largest k, and moves among the candidates.
START_ROUNDS = 5
OVERSAMPLING = 4
START_MOVES = 30


def _points(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """All columns and `_point`, the measures as an array; stored, since every iteration reads it."""
    points = checkpointed(df.withColumn("_point", F.array(*[number(df, c) for c in cols])))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if points.rdd.getNumPartitions() < cores and points.count() > SPREAD_ROWS:
        points = checkpointed(points.repartition(cores, quoted(key)))
    return points


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, the first one on ties; squared distance to it), one centre at a time."""
    label, far = np.zeros(len(x), dtype="int64"), np.full(len(x), np.inf)
    for j, c in enumerate(centres):
        square = ((x - c) ** 2).sum(axis=1)
        closer = square < far
        label[closer], far[closer] = j, square[closer]
    return label, far


def _weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of weighted candidates: drawn with chances that grow with weight and squared distance, of 2 + ln k draws the
    one that leaves the least distances; then moved to the weighted means."""
    rng = np.random.default_rng(seed)
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < k:
        far = weights * _nearest(points, centres)[1]
        total = far.sum()
        picks = rng.choice(len(points), size=2 + int(math.log(k)), p=far / total if total > 0 else None)
        tried = [np.vstack([centres, points[pick]]) for pick in picks]
        centres = min(tried, key=lambda c: (weights * _nearest(points, c)[1]).sum())
    for _ in range(START_MOVES):
        label = _nearest(points, centres)[0]
        mass = np.bincount(label, weights=weights, minlength=k)
        sums = np.column_stack([np.bincount(label, weights=weights * column, minlength=k) for column in points.T])
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _draws(h: np.ndarray, salt: int) -> np.ndarray:
    """Exponential draws that follow the hashes and the salt."""
    x = h.view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return -np.log(((x ^ x >> np.uint64(31)) >> np.uint64(11)) / 2.0**53 + 2.0**-54)


def _candidates(points: DataFrame, key: str, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates for the starts, how many points are nearest to each), the same way for tables of any size.

    A first point is drawn, then a fixed number of rounds adds `OVERSAMPLING * k` points each, without replacement and with
    chances that grow with the squared distance to all candidates before: the points with the least exponential draws
    divided by that distance. A round is one pass in which a task sends that many points at most; the last pass counts.
    Draws follow a hash of the key, so the table's layout doesn't matter. A small table's points all become candidates.
    """
    rows = points.select("_point", F.xxhash64(quoted(key).cast("string"), F.lit(seed)).alias("_h"))
    first = rows.agg(F.min_by("_point", "_h").alias("p")).first()["p"]
    if first is None:
        raise ValueError("no rows to cluster")
    found, many = np.array([first], dtype=float), OVERSAMPLING * k
    for salt in range(START_ROUNDS):
        def least(batches, found=found, salt=salt):
            best = None
            for b in batches:
                if len(b):
                    x, h = np.stack(b["_point"].to_numpy()), b["_h"].to_numpy()
                    with np.errstate(divide="ignore"):
                        score = _draws(h, salt) / _nearest(x, found)[1]
                    new = np.flatnonzero(np.isfinite(score))
                    new = new[np.lexsort((h[new], score[new]))[:many]]
                    if not len(new):
                        continue
                    part = pd.DataFrame({"score": score[new], "h": h[new], "point": list(x[new])})
                    best = part if best is None else pd.concat([best, part]).sort_values(["score", "h"]).head(many)
            if best is not None:
                yield best

        drawn = rows.mapInPandas(least, "score double, h long, point array<double>").orderBy("score", "h").limit(many).collect()
        if not drawn:
            break
        found = np.vstack([found, [r["point"] for r in drawn]])
        if len(drawn) < many:  # all distinct points are candidates
            break

    def weights(batches):
        total = np.zeros(len(found))
        for b in batches:
            if len(b):
                total += np.bincount(_nearest(np.stack(b["_point"].to_numpy()), found)[0], minlength=len(found))
        yield pd.DataFrame({"i": np.arange(len(found)), "n": total})

    counted = rows.mapInPandas(weights, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(len(found))
    for r in counted:
        weight[r["i"]] = r["n"]
    return found[weight > 0], weight[weight > 0]


def _best_fits(points: DataFrame, key: str, ks: list[int], n_init: int, seed: int, max_iter: int) -> dict[int, tuple[np.ndarray, float]]:
    """For every k the centres and the cost of the best restart.

    The starts of all restarts come from one set of weighted candidates, a fixed number of passes for any k. All restarts
    of all k move on together: an iteration is one aggregate over the points, from which every task sends a few sums
    per centre.
    """
    tasks = [(k, i) for k in ks for i in range(n_init)]
    candidates, weights = _candidates(points, key, max(ks), seed)
    centres = {t: _weighted_start(candidates, weights, k, seed + i) for t, (k, i) in enumerate(tasks)}
    cost, moving, width = {}, set(centres), centres[0].shape[1]
    schema = "task int, centre int, n double, cost double, " + ", ".join(f"s{j} double" for j in range(width))
    for _ in range(max_iter + 1):
        now = {t: centres[t] for t in moving}

        def sums(batches, now=now):
            total = {t: np.zeros((len(c), 2 + width)) for t, c in now.items()}
            for b in batches:
                if len(b):
                    x = np.stack(b["_point"].to_numpy())
                    for t, c in now.items():
                        label, far = _nearest(x, c)
                        for column, weight in enumerate([np.ones(len(x)), far, *x.T]):
                            total[t][:, column] += np.bincount(label, weights=weight, minlength=len(c))
            for t, rows in total.items():
                yield pd.DataFrame({"task": t, "centre": np.arange(len(rows)), "n": rows[:, 0], "cost": rows[:, 1],
                                    **{f"s{j}": rows[:, 2 + j] for j in range(width)}})

        names = ["n", "cost", *[f"s{j}" for j in range(width)]]
        found = points.select("_point").mapInPandas(sums, schema).groupBy("task", "centre").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        for t, rows in found.groupby("task"):
            rows = rows.sort_values("centre")
            n = rows["n"].to_numpy()
            moved = np.where(n[:, None] > 0, rows[names[2:]].to_numpy() / np.maximum(n, 1)[:, None], centres[t])
            cost[t] = float(rows["cost"].sum())
            if np.allclose(moved, centres[t], rtol=1e-12, atol=1e-12):
                moving.discard(t)
            centres[t] = moved
        if not moving:
            break
    best = {}
    for t, (k, _) in enumerate(tasks):
        if k not in best or cost[t] < best[k][1]:
            best[k] = (centres[t], cost[t])
    return best


def _label(df: DataFrame, centres: np.ndarray, out: str) -> DataFrame:
    """Add the number of the nearest centre, the first one on ties."""
    far = F.array(*[sum(((F.get("_point", F.lit(j)) - F.lit(float(v))) ** 2 for j, v in enumerate(c)), F.lit(0.0)) for c in centres])
    return df.withColumn(out, (F.array_position(far, F.array_min(far)) - 1).cast("int"))


def kmeans(
    df: DataFrame, key: str, cols: list[str], k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300
) -> tuple[DataFrame, float]:
    """(rows with a `cluster` column, inertia) of the best of `n_init` restarts."""
    points = _points(df, key, cols)
    centres, cost = _best_fits(points, key, [k], n_init, seed, max_iter)[k]
    return stable_cluster_numbers(_label(points, centres, "_cluster").drop("_point"), key, "_cluster"), cost


def stable_cluster_numbers(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """Number the clusters by descending size, then by smallest key, in place of the arbitrary ids."""
    order = df.groupBy(quoted(cluster).alias("_c")).agg(F.count("*").alias("n"), F.min(quoted(key)).alias("k"))
    ids = [r["_c"] for r in order.orderBy(F.desc("n"), "k").collect()]  # one row per cluster
    number_of = F.coalesce(*[F.when(quoted(cluster) == c, F.lit(i)) for i, c in enumerate(ids)])
    return df.withColumn("cluster", number_of).drop(cluster)


def _pack(means: list[np.ndarray], spreads: list[np.ndarray]):
    """Function that turns the points of a block into one row: the points, and the clusters each of them has to look at.

    The mean distance to a cluster is at least the distance to its centre and at most the root of that distance squared plus the
    cluster's mean squared deviation. Clusters that are farther at least than another one is at most can't be the nearest.
    """
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        label, cluster = int(rows["label"].iloc[0]), int(rows["cluster"].iloc[0])
        x = np.stack(rows["x"].to_numpy()).astype(float)
        least = np.column_stack([np.sqrt(((x - m) ** 2).sum(axis=1)) for m in means[label]])
        most = np.sqrt(least**2 + spreads[label])
        most[:, cluster] = np.inf
        wanted = least <= most.min(axis=1, keepdims=True) * (1 + 1e-9)
        wanted[:, cluster] = True
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]], "label": [label], "cluster": [cluster], "x": [x.tobytes()],
            "wanted": [wanted.tobytes()], "looks_at": [np.flatnonzero(wanted.any(axis=0)).tolist()]})

    return pack


def _block_distances(sizes: list[np.ndarray], width: int):
    """Function from the one or two blocks of a pair to the shares of mean distances that each side takes from the other."""
    def points(block):
        return np.frombuffer(block["x"]).reshape(-1, width)

    def share(of, other, sums):
        n = sizes[of["label"]]
        wanted = np.frombuffer(of["wanted"], dtype=bool).reshape(-1, len(n))[:, other["cluster"]]
        own = of["cluster"] == other["cluster"]
        return pd.DataFrame({
            "block": of["block"], "place": np.flatnonzero(wanted), "label": of["label"], "cluster": other["cluster"], "own": own,
            "alone": own and n[of["cluster"]] == 1, "mean": sums[wanted] / max(1, n[other["cluster"]] - own)})

    def distances(pair: pd.DataFrame) -> pd.DataFrame:
        sides = pair.sort_values("block").to_dict("records")
        a, b = sides[0], sides[-1]
        xa, xb = points(a), points(b)
        square = np.zeros((len(xa), len(xb)))
        for d in range(width):
            square += (xa[:, d][:, None] - xb[:, d][None, :]) ** 2
        dist = np.sqrt(square)
        shares = [share(a, b, dist.sum(axis=1))]
        if len(sides) == 2:
            shares.append(share(b, a, dist.sum(axis=0)))
        return pd.concat(shares)

    return distances


def silhouettes(df: DataFrame, key: str, cols: list[str], labels: list[str], block_rows: int = BLOCK_ROWS) -> dict[str, float]:
    """Exact mean Euclidean silhouette of each label column; members of one-row clusters count 0, rows without a label don't count.

    With a single cluster the silhouette is undefined (null).

    Every cluster is hashed into blocks of about `block_rows` points, packed into one row each. A pair of blocks is
    one task that turns its distances into sums for both sides, so distances are never stored and memory stays
    bounded; pairs of which neither side can be near the other's cluster are left out.
    """
    table = checkpointed(df.select(
        quoted(key).alias("key"), F.array(*[number(df, c) for c in cols]).alias("x"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("label"), quoted(c).cast("string").alias("value")) for i, c in enumerate(labels)])),
    ).where("value IS NOT NULL"))
    width = len(cols)
    found = table.groupBy("label", "value").agg(
        F.count("*").alias("n"), F.array(*[F.avg(F.get("x", F.lit(j))) for j in range(width)]).alias("mean"),
        sum((F.var_pop(F.get("x", F.lit(j))) for j in range(width)), F.lit(0.0)).alias("spread"),
    ).orderBy("label", "value").collect()  # one row per cluster
    clusters = [[r for r in found if r["label"] == i] for i in range(len(labels))]
    sizes = [np.array([r["n"] for r in c]) for c in clusters]
    pack = _pack([np.array([r["mean"] for r in c]) for c in clusters], [np.array([r["spread"] for r in c]) for c in clusters])
    numbered, first = [], 0
    for c in clusters:
        for j, r in enumerate(c):
            parts = math.ceil(r["n"] / block_rows)
            numbered.append((r["label"], r["value"], j, first, parts))
            first += parts
    numbers_of = df.sparkSession.createDataFrame(numbered, "label int, value string, cluster int, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("key", "label"), F.col("parts"))
    blocks = checkpointed(
        table.join(F.broadcast(numbers_of), ["label", "value"]).select("label", "cluster", block.alias("block"), "x")
        .groupBy("block").applyInPandas(
            pack, "block long, label int, cluster int, x binary, wanted binary, looks_at array<int>"))
    looking = blocks.select(F.col("block").alias("a"), "label", F.explode("looks_at").alias("cluster"))
    seen = blocks.select(F.col("block").alias("b"), "label", "cluster")
    pairs = checkpointed(looking.join(seen, ["label", "cluster"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # Blocks are small for the work they mean: partitions made by their bytes would leave it to a few tasks.
    parts = max(1, math.ceil(pairs.count() / TASK_PAIRS))
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    shares = sides.join(blocks, "block").repartition(parts, "a", "b").groupBy("a", "b").applyInPandas(
        _block_distances(sizes, width), "block long, place long, label int, cluster int, own boolean, alone boolean, mean double")
    means = shares.groupBy("label", "block", "place", "cluster", "own", "alone").agg(F.sum("mean").alias("mean"))
    scored = means.groupBy("label", "block", "place").agg(
        F.max("alone").alias("alone"), F.max(F.when(F.col("own"), F.col("mean"))).alias("a"),
        F.min(F.when(~F.col("own"), F.col("mean"))).alias("b"))
    s = F.when(F.col("alone"), F.lit(0.0)).when(
        F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    result = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg(s).alias("m")).collect()}
    return {label: result.get(i) for i, label in enumerate(labels)}


def silhouette(df: DataFrame, key: str, cols: list[str], cluster: str = "cluster") -> DataFrame:
    value = silhouettes(df, key, cols, [cluster])[cluster]
    return df.sparkSession.createDataFrame([(value,)], "silhouette double")


def choose_k(
    df: DataFrame, key: str, cols: list[str], ks=range(2, 7), n_init: int = 10, seed: int = 42, max_iter: int = 300
) -> tuple[DataFrame, int, DataFrame]:
    """(table of `k`, `inertia`, `silhouette`; best k; rows with the best `cluster`).

    Values of k that are not below the number of rows are left out.
    """
    points = _points(df, key, cols)
    n = points.count()
    ks = [k for k in ks if k < n]
    if not ks:
        raise ValueError("too few rows to cluster")
    fits = _best_fits(points, key, ks, n_init, seed, max_iter)
    labelled = points
    for k, (centres, _) in fits.items():
        labelled = _label(labelled, centres, f"_k{k}")
    labelled = checkpointed(labelled.drop("_point"))
    quality = silhouettes(labelled, key, cols, [f"_k{k}" for k in ks])
    table = df.sparkSession.createDataFrame(
        [(k, fits[k][1], quality[f"_k{k}"]) for k in ks], "k int, inertia double, silhouette double"
    )
    best = best_by(table, "silhouette", "k").first()["k"]
    chosen = stable_cluster_numbers(
        labelled.select(*[quoted(c) for c in df.columns], F.col(f"_k{best}").alias("_chosen")), key, "_chosen")
    return table, best, chosen
