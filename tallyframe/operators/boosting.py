"""Second-order gradient boosting of trees for a binary class, on histograms.

Every feature is cut once at its exact quantiles into bins of a byte. Each tree sees its own share of the rows, by a hash of
their number, and of the features. One pass makes all draws: rows of equal bins and label become one row that holds for every
tree how many of them it sees. A tree grows level by level: one pass adds up the gradients and Hessians of the logistic loss
per node, feature and bin, and the driver, which sees these sums and never a row, takes the split of the largest regularised
gain for every node. Where few rows differ, one task holds them all and grows all trees the same way.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.blocks import BLOCK_BYTES, WEIGHED_KINDS, Weighed, blocks, counted, in_blocks, looked_up, packed, weighed
from tallyframe.operators.quantiles import quantile_values
from tallyframe.session import checkpointed, quoted

# Least gain of a split.
LEAST_GAIN = 1e-6
# Trees whose values rows look up anew in every pass before they are stored with the rows.
PENDING_TREES = 10
# Sums of all tasks that the driver adds up itself; larger ones are added up on the executors.
DRIVER_BYTES = 64 << 20
# Distinct rows with which one task grows all trees.
TASK_ROWS = 1 << 17
# Distinct rows whose chances a task that scores keeps.
KNOWN_ROWS = 1 << 16


def _param(name: str, doc: str, kind=TypeConverters.toFloat):
    return Param(Params._dummy(), name, doc, kind)


class _Tree:
    """Nodes in the order they were made: split feature (-1: leaf), last bin that goes left, children, value, gain."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value, self.gain = ([] for _ in range(6))

    def add(self, value: float) -> int:
        for part, x in zip((self.feature, self.bin, self.left, self.right, self.value, self.gain), (-1, 0, 0, 0, value, 0.0)):
            part.append(x)
        return len(self.feature) - 1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf, as far as the tree has grown, of every row of a matrix of bins."""
        feature, last, left, right = (np.array(x, np.int64) for x in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(bins[inner, feature[node]] <= last[node], left[node], right[node])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(bins)]


def _drawn(rows: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Whether a tree sees a row, by the number of the row."""
    x = rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2.0 ** 64), (1 << 64) - 1))


def _margins(record: pa.RecordBatch, x: np.ndarray, trees: list[_Tree]) -> np.ndarray:
    """Margins of the distinct rows: those stored with the block, if any, and the values of the trees since."""
    known = np.frombuffer(record.column("margin")[0].as_buffer()) if "margin" in record.schema.names else np.zeros(len(x))
    return known + sum((t.values(x) for t in trees), np.zeros(len(x)))


def best_split(g: np.ndarray, h: np.ndarray, penalty: float, least_weight: float):
    """(gain, feature, bin, sums left) of the best split from sums (features, bins); None if none gains. Ties: least feature, bin."""
    left_g, left_h = g.cumsum(1), h.cumsum(1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda a, b: a * a / (b + penalty)
    gain = 0.5 * (score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h))
    gain = np.where((left_h >= least_weight) & (right_h >= least_weight), gain, -np.inf)[:, :-1]
    if not gain.size or gain.max() <= LEAST_GAIN:
        return None
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return gain[f, b], int(f), int(b), left_g[f, b], left_h[f, b]


def _level_sums(x, y, weight, margin, tree: _Tree, front: list[int], columns: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums of gradients and Hessians (2, node, feature, bin) over rows that stand for `weight` rows each."""
    slot_of = np.full(len(tree.feature), -1)
    slot_of[front] = np.arange(len(front))
    sums = np.zeros((2, len(front), len(columns), n_bins))
    slot = slot_of[tree.node_of(x)]
    p = 1 / (1 + np.exp(-margin))
    here = np.flatnonzero((slot >= 0) & (weight > 0))
    grads, base = ((weight * (p - y))[here], (weight * p * (1 - p))[here]), slot[here] * n_bins
    for i, c in enumerate(columns):
        cell = base + x[here, c]
        for k, w in enumerate(grads):
            sums[k, :, i] += np.bincount(cell, w, len(front) * n_bins).reshape(len(front), n_bins)
    return sums


def _grown(sums, columns: np.ndarray, depth: int, penalty: float, least: float, step: float) -> _Tree:
    """A tree, by the sums of gradients and Hessians that `sums(tree, front)` takes for the nodes of a level."""
    tree = _Tree()
    front = [tree.add(0.0)]
    for level in range(depth):
        g, h = sums(tree, front)
        if level == 0:
            tree.value[0] = -g[0, 0].sum() / (h[0, 0].sum() + penalty) * step
        below = []
        for slot, node in enumerate(front):
            found = best_split(g[slot], h[slot], penalty, least)
            if found is None:
                continue
            gain, f, b, left_g, left_h = found
            all_g, all_h = g[slot, f].sum(), h[slot, f].sum()
            tree.feature[node], tree.bin[node], tree.gain[node] = int(columns[f]), b, float(gain)
            tree.left[node] = tree.add(float(-left_g / (left_h + penalty) * step))
            tree.right[node] = tree.add(float(-(all_g - left_g) / (all_h - left_h + penalty) * step))
            below += [n for n, w in ((tree.left[node], left_h), (tree.right[node], all_h - left_h)) if w >= 2 * least]
        front = below
        if not front:
            break
    return tree


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees with step size, share of rows and of features per tree, and an L2 penalty on the leaves."""

    rounds = _param("rounds", "number of trees", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "most levels of splits", TypeConverters.toInt)
    maxBins = _param("maxBins", "most bins of a feature, 256 at most", TypeConverters.toInt)
    seed = _param("seed", "of the shares of rows and features", TypeConverters.toInt)
    stepSize = _param("stepSize", "factor of every leaf's weight")
    rowShare = _param("rowShare", "share of the rows per tree")
    featureShare = _param("featureShare", "share of the features per tree")
    penalty = _param("penalty", "L2 penalty on leaf weights")
    leastWeight = _param("leastWeight", "least sum of Hessians of a child")

    def __init__(self, featuresCol="features", labelCol="label", rounds=200, maxDepth=6, maxBins=256, seed=42, stepSize=0.1,
                 rowShare=0.8, featureShare=0.8, penalty=1.0, leastWeight=1.0):
        super().__init__()
        if not 2 <= maxBins <= 256:
            raise ValueError("maxBins must lie in 2..256")
        self._set(featuresCol=featuresCol, labelCol=labelCol, rounds=rounds, maxDepth=maxDepth, maxBins=maxBins, seed=seed,
                  stepSize=stepSize, rowShare=rowShare, featureShare=featureShare, penalty=penalty, leastWeight=leastWeight)

    def _fit(self, df: DataFrame) -> "BoostedTreesModel":
        """Rows without a label are left out; labels are 0 or 1."""
        get = self.getOrDefault
        rows = df.select(quoted(self.getLabelCol()).cast("double").alias("y"), vector_to_array(quoted(self.getFeaturesCol())).alias("x")) \
            .where("y IS NOT NULL")
        cores = df.sparkSession.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:  # few large partitions would leave cores idle
            rows = rows.repartition(cores)
        blocks_ = packed(rows.select(F.monotonically_increasing_id().alias("row"), "y", "x"), np.float64)
        width, n_bins = blocks_.agg(F.max("width")).first()[0] or 0, get("maxBins")
        names = [f"x{i}" for i in range(width)]
        probs = [i / n_bins for i in range(n_bins)] + [1.0]
        marks = quantile_values(counted(blocks_, width, np.float64), names, probs, weight="n") if width else {}
        # A bin ends at its cut; every value but the largest may be one, so that also a rare indicator can be split on.
        cuts = [np.array(sorted({v for v in marks[n][:-1] if v is not None and v < marks[n][-1]})[: n_bins - 1]) for n in names]

        def code(x):
            bins = np.empty(x.shape, np.uint8)
            for i, c in enumerate(cuts):
                bins[:, i] = np.searchsorted(c, x[:, i], "left")
            return bins

        draw = np.random.default_rng(get("seed"))
        columns_of = [np.sort(draw.permutation(width)[: max(1, round(get("featureShare") * width))]) for _ in range(get("rounds") if width else 0)]
        bins = max((len(c) + 1 for c in cuts), default=1)
        seed, share, options = get("seed"), get("rowShare"), (get("maxDepth"), get("penalty"), get("leastWeight"), get("stepSize"))
        numbers = list(range(len(columns_of)))

        def weigh(batches):
            found = (Weighed.of_block(b.coded(code), lambda r, t: _drawn(r, seed, t, share), numbers) for _, b in blocks(batches, np.float64))
            for part in in_blocks(found):
                yield from part.records()

        trees = []
        if columns_of:
            stored, few = self._merged(checkpointed(blocks_.mapInArrow(weigh, WEIGHED_KINDS)))
            trees = (self._in_one_task if few else self._by_passes)(stored, columns_of, bins, options)
        told = [{"feature": t.feature, "left": t.left, "right": t.right, "value": t.value, "gain": t.gain,
                 "cut": [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]} for t in trees]
        return BoostedTreesModel(self.getFeaturesCol(), json.dumps(told), width)

    def _merged(self, stored: DataFrame) -> tuple[DataFrame, bool]:
        """The blocks, equal rows of several tasks brought together where there are many, and whether one task may hold all."""
        def merge(batches):
            for part in in_blocks(_parts(batches)):
                yield from part.records()

        bytes_ = F.octet_length("y") + F.octet_length("x") + F.octet_length("w")
        sums = [F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("held"), F.col("n"), bytes_)]
        held, n, size = stored.agg(*sums).first()
        if held > TASK_ROWS and 2 * held <= n:
            few = max(1, min(stored.rdd.getNumPartitions(), size // BLOCK_BYTES))
            stored = checkpointed(stored.coalesce(few).mapInArrow(merge, WEIGHED_KINDS))
            held = stored.agg(sums[0]).first()[0]
        return stored, held <= TASK_ROWS

    def _in_one_task(self, stored: DataFrame, columns_of: list[np.ndarray], bins: int, options: tuple) -> list[_Tree]:
        """All trees, grown by one task that holds the distinct rows."""
        def grow(batches):
            parts = list(_parts(batches))
            if not parts:
                return
            part = Weighed.merged(parts)
            known, margin, trees = np.zeros(len(part.y)), np.zeros(len(part.y)), []
            for t, columns in enumerate(columns_of):
                if t % PENDING_TREES == 0:
                    known, margin = known + margin, np.zeros(len(part.y))
                now, weight = known + margin, part.w[t].astype(float)
                trees.append(_grown(lambda tree, front: _level_sums(part.x, part.y, weight, now, tree, front, columns, bins), columns, *options))
                margin += trees[-1].values(part.x)
            told = json.dumps([[t.feature, t.bin, t.left, t.right, t.value, t.gain] for t in trees])
            yield pa.RecordBatch.from_arrays([pa.array([told])], names=["trees"])

        trees = []
        for told in (r["trees"] for r in stored.coalesce(1).mapInArrow(grow, "trees string").collect()):
            for parts in json.loads(told):
                trees.append(_Tree())
                trees[-1].feature, trees[-1].bin, trees[-1].left, trees[-1].right, trees[-1].value, trees[-1].gain = parts
        return trees

    def _by_passes(self, stored: DataFrame, columns_of: list[np.ndarray], bins: int, options: tuple) -> list[_Tree]:
        """All trees, each level from sums of a pass over the blocks."""
        cores, partitions = stored.sparkSession.sparkContext.defaultParallelism, stored.rdd.getNumPartitions()
        if partitions < cores:
            stored, partitions = stored.repartition(cores), cores
        kinds, trees, kept = WEIGHED_KINDS + ", margin binary", [], 0
        for t, columns in enumerate(columns_of):
            pending = trees[kept:]
            trees.append(_grown(lambda tree, front: self._sums(stored, pending, tree, front, t - kept, columns, bins, partitions), columns, *options))
            if len(trees) - kept >= PENDING_TREES and t + 1 < len(columns_of):
                pending, kept = trees[kept:], len(trees)

                def settle(batches, pending=pending):  # the weights of the trees that are done go
                    for record, _, x, _ in weighed(batches, np.float64, np.uint8):
                        margin = pa.array([_margins(record, x, pending).tobytes()], pa.binary())
                        size = -(-record.column("held")[0].as_py() * record.column("bits")[0].as_py() // 8)
                        w = pa.array([memoryview(record.column("w")[0].as_buffer())[len(pending) * size:].tobytes()], pa.binary())
                        yield pa.RecordBatch.from_arrays([*record.columns[:5], w, margin], names=[k.split()[0] for k in kinds.split(", ")])

                stored = checkpointed(stored.mapInArrow(settle, kinds))
        return trees

    def _sums(self, stored, pending, tree, front, place, columns, n_bins, partitions):
        """Sums of gradients and Hessians (2, node, feature, bin) over the rows that the tree sees."""
        shape = (len(front), len(columns), n_bins)

        def add(batches):
            sums = np.zeros((2, *shape))
            for record, y, x, weights in weighed(batches, np.float64, np.uint8):
                sums += _level_sums(x, y, weights(place).astype(float), _margins(record, x, pending), tree, front, columns, n_bins)
            yield sums

        if partitions * 16 * int(np.prod(shape)) <= DRIVER_BYTES:
            def whole(batches):
                for sums in add(batches):
                    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["s"])

            parts = sorted(r["s"] for r in stored.mapInArrow(whole, "s binary").collect())
            return sum((np.frombuffer(s).reshape(2, *shape) for s in parts), np.zeros((2, *shape)))

        def cells(batches):
            for sums in add(batches):
                flat = sums.reshape(2, -1)
                at = np.flatnonzero(flat[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0, at]), pa.array(flat[1, at])], names=["cell", "g", "h"])

        found = stored.mapInArrow(cells, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((2, int(np.prod(shape))))
        out[:, found.column("cell").to_numpy()] = found.column("g").to_numpy(), found.column("h").to_numpy()
        return out.reshape(2, *shape)


def _parts(batches):
    """The weighed blocks of a task."""
    for record, y, x, weights in weighed(batches, np.float64, np.uint8):
        held, bits, w = len(y), record.column("bits")[0].as_py(), record.column("w")[0].as_buffer()
        trees = len(w) // -(-held * bits // 8)
        yield Weighed(record.column("n")[0].as_py(), y, x, np.stack([weights(i) for i in range(trees)]) if trees else np.zeros((0, held), np.uint8))


class BoostedTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    trees = _param("trees", "JSON list of trees", TypeConverters.toString)
    width = _param("width", "number of features", TypeConverters.toInt)

    def __init__(self, featuresCol=None, trees=None, width=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(featuresCol=featuresCol, trees=trees, width=width).items() if v is not None})

    def all_trees(self) -> list[dict]:
        return json.loads(self.getOrDefault("trees"))

    @property
    def featureImportances(self) -> DenseVector:
        """Gains of a feature's splits in all trees, as shares of all features'."""
        total = np.zeros(self.getOrDefault("width"))
        for t in self.all_trees():
            for f, gain in zip(t["feature"], t["gain"]):
                if f >= 0:
                    total[f] += gain
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = [{k: np.array(v) for k, v in t.items()} for t in self.all_trees()]
        width = self.getOrDefault("width")

        def chance_of(x: np.ndarray) -> np.ndarray:
            margin = np.zeros(len(x))
            for t in trees:
                at = np.zeros(len(x), np.int64)
                inner = np.flatnonzero(t["feature"][at] >= 0)
                while len(inner):
                    node = at[inner]
                    at[inner] = np.where(x[inner, t["feature"][node]] <= t["cut"][node], t["left"][node], t["right"][node])
                    inner = inner[t["feature"][at[inner]] >= 0]
                margin += t["value"][at]
            return 1 / (1 + np.exp(-margin))

        @F.arrow_udf(T.DoubleType())
        def chance(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = {}
            for features in parts:
                x = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(features), 0))
                yield pa.array(looked_up(x, known, KNOWN_ROWS, chance_of))

        p = chance(vector_to_array(quoted(self.getFeaturesCol())))
        return df.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")})
