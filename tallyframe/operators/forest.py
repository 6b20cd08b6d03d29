"""Random forest of fully grown classification trees.

The rows lie in packed blocks, in which equal rows are one row with the sum of their draws. A tree starts on all rows: one
aggregate per level counts the classes per node, feature and bin for every tree of a pass, the
best split of a node is chosen on the executors, and only the splits reach the driver. As soon as the rows of a node fit
one task (all rows, where few of them differ) they are brought together, and `applyInArrow` grows the rest of the branch there
at exact values, to pure leaves and without a limit on depth. The driver holds the trees, which are the model, and never a row.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.blocks import Block, Weighed, blocks, distinct, in_blocks, looked_up, packed, unpacked
from tallyframe.operators.boosting import _param
from tallyframe.operators.quantiles import quantile_values
from tallyframe.session import quoted

# Bytes of a node's rows that one task finishes.
TASK_BYTES = 64 << 20
# Copies of rows that the trees of one pass send to their tasks.
PASS_ROWS = 1 << 31
# Distinct rows whose chances a task that scores keeps.
KNOWN_ROWS = 1 << 16
# Class counts of nodes that a task adds up at a time; a level with more of them takes further passes.
PASS_CELLS = 1 << 24
# Chances that a tree draws a row 0, 1, 2, ... times, summed up: a Poisson draw of mean 1, as for a bootstrap of many rows.
DRAWN = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1.0, k + 1))) for k in range(12)])
_NODES = "feature binary, cut binary, left binary, right binary, chance binary, gains binary"
_SENT = "tree long, node long, y binary, n binary, x binary"
_KINDS = {"feature": np.int32, "cut": np.float64, "left": np.int32, "right": np.int32, "chance": np.float32}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of every number."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> int:
    """A number that stands for a sequence of numbers."""
    key = 0
    for p in parts:
        key = int(_mixed(np.array([(key ^ (p * 0xD1342543DE82EF95)) % (1 << 64)], np.uint64))[0])
    return key


def times_drawn(rows: np.ndarray, key: int) -> np.ndarray:
    """How often a tree draws every row, by the number of the row."""
    chance = _mixed(rows.astype(np.uint64) ^ np.uint64(key)) >> np.uint64(11)
    times, most = np.zeros(len(chance), np.int64), chance.max(initial=0)
    for bound in np.ceil(DRAWN * (1 << 53)).astype(np.uint64):
        if bound > most:
            break
        times += chance >= bound
    return times


def in_order(key: int, width: int) -> np.ndarray:
    """The features in the order in which a node looks at them."""
    with np.errstate(over="ignore"):
        return np.argsort(_mixed(np.uint64(key) + np.arange(width, dtype=np.uint64)), kind="stable")


def purity(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums of squared class counts over counts of both sides, -inf for an empty side; classes lie on the last axis."""
    right = total - left
    n, m = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(-1) / n + (right * right).sum(-1) / m
    return np.where((n > 0) & (m > 0), score, -np.inf)


def chosen(key: int, width: int, looks: int, best_of) -> tuple | None:
    """(score, feature, place) of the best split among the first `looks` features, or of the next one that varies.

    `best_of(feature)` gives the score and place of the feature's best split. Ties go to the feature looked at first.
    """
    best = None
    for i, f in enumerate(in_order(key, width)):
        if i >= looks and best is not None:
            break
        score, place = best_of(int(f))
        if score > -np.inf and (best is None or score > best[0]):
            best = score, int(f), place
    return best


class _Nodes:
    """Nodes in the order they were made; a leaf has feature -1 and the shares of the classes."""

    def __init__(self, width: int):
        self.feature, self.cut, self.left, self.right, self.chance, self.gains = [], [], [], [], [], np.zeros(width)

    def add(self, counts: np.ndarray) -> int:
        for part, x in zip((self.feature, self.cut, self.left, self.right), (-1, 0.0, 0, 0)):
            part.append(x)
        self.chance.append(counts / max(counts.sum(), 1))
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float, gain: float, left: int, right: int):
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, right
        self.gains[feature] += gain

    def arrays(self) -> dict:
        return {k: np.array(getattr(self, k), kind) for k, kind in _KINDS.items()}


def node_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of every row of a matrix of values. A value that isn't a number goes right."""
    at = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(tree["feature"][at] >= 0)
    while len(inner):
        node = at[inner]
        at[inner] = np.where(x[inner, tree["feature"][node]] <= tree["cut"][node], tree["left"][node], tree["right"][node])
        inner = inner[tree["feature"][at[inner]] >= 0]
    return at


def rows_of(tree: dict, x: np.ndarray, wanted: dict):
    """(node, its rows) for the wanted leaves of a tree of few nodes, from a matrix of values with a row per feature."""
    todo = [(0, np.arange(x.shape[1]))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        f = tree["feature"][node]
        if f >= 0:
            left = x[f][rows] <= tree["cut"][node]
            todo += [(int(tree["left"][node]), rows[left]), (int(tree["right"][node]), rows[~left])]
        elif node in wanted:
            yield node, rows


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, key: int, depth: int, classes: int, looks: int) -> _Nodes:
    """The tree of some rows, cut at any of their values, at most `depth` levels deep (0: any). No recursion."""
    width = x.shape[1]
    ones = np.zeros((len(y), classes))
    ones[np.arange(len(y)), y] = weight
    nodes = _Nodes(width)
    todo = [(nodes.add(ones.sum(0)), np.arange(len(y)), key, 0)]
    while todo:
        node, rows, key, level = todo.pop()
        own = ones[rows]
        total = own.sum(0)
        if (total > 0).sum() < 2 or (depth and level >= depth):
            continue

        def best_of(f):
            values = x[rows, f]
            order = np.argsort(values, kind="stable")
            values = values[order]
            ends = np.flatnonzero(values[1:] > values[:-1])
            if not len(ends):
                return -np.inf, None
            score = purity(own[order].cumsum(0)[ends], total)
            at = int(score.argmax())
            return score[at], values[ends[at]]

        best = chosen(key, width, looks, best_of)
        if best is None:
            continue
        score, f, cut = best
        left = x[rows, f] <= cut
        sides = [(nodes.add(ones[part].sum(0)), part, _key(key, side), level + 1)
                 for side, part in enumerate((rows[left], rows[~left]))]
        nodes.split(node, f, cut, score - (total * total).sum() / total.sum(), sides[0][0], sides[1][0])
        todo += sides
    return nodes


class RandomForest(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees on bootstrap draws of the rows; every node looks at `looks` features (0: the root of their number).

    With `keyCol`, the name of a unique column, the draws follow the key and are the same in every run; without it they follow
    the places of the rows.
    """

    trees = _param("trees", "number of trees", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "most levels of splits, 0 for any", TypeConverters.toInt)
    maxBins = _param("maxBins", "most bins of a feature in nodes beyond a task", TypeConverters.toInt)
    looks = _param("looks", "features a node looks at, 0 for the root of their number", TypeConverters.toInt)
    seed = _param("seed", "of the draws of rows and features", TypeConverters.toInt)
    bootstrap = _param("bootstrap", "whether trees draw rows", TypeConverters.toBoolean)
    keyCol = _param("keyCol", "column whose values the draws of rows follow, empty for none", TypeConverters.toString)
    taskBytes = _param("taskBytes", "bytes of the rows of a node that one task finishes", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", trees=200, maxDepth=0, maxBins=256, looks=0, seed=42,
                 bootstrap=True, keyCol="", taskBytes=TASK_BYTES):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, trees=trees, maxDepth=maxDepth, maxBins=maxBins, looks=looks,
                  seed=seed, bootstrap=bootstrap, keyCol=keyCol, taskBytes=taskBytes)

    def _fit(self, df: DataFrame) -> "RandomForestModel":
        """Rows without a label are left out; labels are 0, 1, ..."""
        get = self.getOrDefault
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
        number = F.xxhash64(quoted(get("keyCol"))) if get("keyCol") else F.monotonically_increasing_id()
        rows = df.select(number.alias("row"), quoted(self.getLabelCol()).cast("int").alias("y"),
                           vector_to_array(quoted(self.getFeaturesCol())).alias("x")).where("y IS NOT NULL")
        rows = packed(rows, np.int32)
        size = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in ((F.col("n"), "n"), (F.octet_length("y"), "own"))],
                        F.max("last").alias("last"), F.max("width").alias("width")).first()
        n, width, classes = size["n"], size["width"] or 0, max(2, int(size["last"] or 0) + 1)
        task_rows = max(2, get("taskBytes") // (8 * width + 24))
        held = size["own"] // np.dtype(np.int32).itemsize  # distinct rows of the blocks
        merges = 2 * held <= n
        if merges and held > task_rows:
            held = self._held(rows)
        fits = n <= task_rows or (merges and held <= task_rows)
        cuts = [] if fits else self._cuts(rows, width)
        looks, seed = get("looks") or max(1, int(width ** 0.5)), get("seed")
        draws = {t: _key(seed, t) for t in range(get("trees"))}
        a_pass = max(1, PASS_ROWS // max(held if fits and merges else n, 1))
        done = []
        for start in range(0, get("trees") if n else 0, a_pass):
            numbers = list(range(start, min(start + a_pass, get("trees"))))
            tops, open_nodes = self._tops(rows, numbers, draws, cuts, width, classes, looks, fits, task_rows)
            done += self._finished(rows, tops, open_nodes, draws, width, classes, looks, fits and merges)
        return RandomForestModel(self.getFeaturesCol(), width, classes, done)

    def _held(self, rows: DataFrame) -> int:
        """Distinct rows, those of a task counted together."""
        def count(batches):
            found = (Weighed(len(b.row), b.y, b.x, np.zeros((0, len(b.y)), np.uint8)) for _, b in blocks(batches, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(p.y) for p in in_blocks(found))])], names=["held"])

        return _few_tasks(rows).mapInArrow(count, "held long").agg(F.sum("held")).first()[0]

    def _cuts(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        n_bins = self.getOrDefault("maxBins")
        names = [f"x{i}" for i in range(width)]
        marks = quantile_values(unpacked(rows, width, np.int32), names, [i / n_bins for i in range(n_bins)] + [1.0])
        return [np.array(sorted({v for v in marks[c][:-1] if v is not None and v < marks[c][-1]})[: n_bins - 1]) for c in names]

    def _reader(self, tops: dict, draws: dict, wanted: dict):
        """Function of a block: (tree, node, weights, places) of the distinct rows that a tree draws, node by wanted node."""
        bootstrap = self.getOrDefault("bootstrap")
        arrays = {t: top.arrays() for t, top in tops.items() if wanted.get(t)}

        def read(block: Block):
            x = np.ascontiguousarray(block.x.T)
            for t, top in arrays.items():
                drawn = None
                if len(block.y) < len(block.row):  # equal rows: one with the sum of their draws
                    drawn = block.weights(times_drawn(block.row, draws[t]) if bootstrap else np.ones(len(block.row))).astype(np.int64)
                for node, rows in rows_of(top, x, wanted[t]):
                    weight = drawn[rows] if drawn is not None else times_drawn(block.row[rows], draws[t]) if bootstrap else np.ones(len(rows), np.int64)
                    here = np.flatnonzero(weight)
                    if len(here):
                        yield t, node, weight[here], rows[here]

        return read

    def _tops(self, rows, numbers, draws, cuts, width, classes, looks, fits, task_rows):
        """Trees down to the nodes that fit a task, and per tree these nodes with their keys and levels."""
        depth = self.getOrDefault("maxDepth")
        tops = {t: _Nodes(width) for t in numbers}
        for top in tops.values():
            top.add(np.zeros(classes))
        front = {t: {0: (_key(draws[t], 0), 0)} for t in numbers}
        if fits:
            return tops, front
        ready = {t: {} for t in numbers}
        while any(front.values()):
            below = {t: {} for t in numbers}
            for s in self._splits(rows, tops, draws, front, cuts, width, classes, looks, depth):
                top, t, node = tops[s["tree"]], s["tree"], s["node"]
                key, level = front[t][node]
                total = np.array(s["total"])
                top.chance[node] = total / total.sum()
                if s["feature"] < 0:
                    continue
                left = np.array(s["below"])
                sides = [top.add(left), top.add(total - left)]
                top.split(node, s["feature"], float(cuts[s["feature"]][s["bin"]]), s["score"] - (total * total).sum() / total.sum(), *sides)
                for side, (child, counts) in enumerate(zip(sides, (left, total - left))):
                    if (counts > 0).sum() > 1 and not (depth and level + 1 >= depth):
                        (ready if counts.sum() <= task_rows else below)[t][child] = (_key(key, side), level + 1)
            front = below
        return tops, ready

    def _splits(self, rows, tops, draws, front, cuts, width, classes, looks, depth):
        """The best split of every node of the front, from class counts per feature and bin added up on the executors."""
        cells = sum(len(c) + 1 for c in cuts) * classes
        nodes = [(t, node) for t, own in front.items() for node in own]
        a_pass = max(1, PASS_CELLS // cells)
        found = []
        for start in range(0, len(nodes), a_pass):
            wanted = {}
            for t, node in nodes[start: start + a_pass]:
                wanted.setdefault(t, {})[node] = front[t][node]
            found += self._node_splits(rows, tops, draws, wanted, cuts, width, classes, looks)
        return sorted(found, key=lambda s: (s["tree"], s["node"]))

    def _node_splits(self, rows, tops, draws, front, cuts, width, classes, looks):
        read = self._reader(tops, draws, front)
        starts = np.cumsum([0, *(len(c) + 1 for c in cuts)])
        keys = {(t, node): key for t, nodes in front.items() for node, (key, _) in nodes.items()}

        def count(batches):
            sums = {}
            for _, block in blocks(batches, np.int32):
                cell = [np.searchsorted(c, block.x[:, f], "left") * classes + block.y for f, c in enumerate(cuts)]
                for t, node, weight, here in read(block):
                    own, weight = sums.setdefault((t, node), np.zeros(starts[-1] * classes)), weight.astype(float)
                    for f in range(width):
                        part = own[starts[f] * classes: starts[f + 1] * classes]
                        part += np.bincount(cell[f][here], weight, len(part))
            for (t, node), own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([node]), pa.array([own.tobytes()], pa.binary())],
                                                 names=["tree", "node", "counts"])

        def choose(table: pa.Table) -> pa.Table:
            t, node = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            counts = sum(np.frombuffer(c.as_buffer()) for c in table.column(2)).reshape(-1, classes)
            total = counts[: starts[1]].sum(0)

            def best_of(f):
                score = purity(counts[starts[f]: starts[f + 1] - 1].cumsum(0), total)
                if not len(score):
                    return -np.inf, None
                at = int(score.argmax())
                return score[at], at

            best = chosen(keys[t, node], width, looks, best_of) if (total > 0).sum() > 1 else None
            score, f, at = best or (0.0, -1, 0)
            left = counts[starts[f]: starts[f] + at + 1].sum(0) if best else np.zeros(classes)
            return pa.table({"tree": [t], "node": [node], "score": [float(score)], "feature": [f], "bin": [at],
                             "below": [left.tolist()], "total": [total.tolist()]})

        counted = rows.mapInArrow(count, "tree long, node long, counts binary")
        kinds = "tree long, node long, score double, feature long, bin long, below array<double>, total array<double>"
        return counted.groupBy("tree", "node").applyInArrow(choose, kinds).collect()

    def _finished(self, rows, tops, open_nodes, draws, width, classes, looks, merges=False) -> list[dict]:
        """Every tree with the branches below its open nodes, each grown by the task that holds the node's rows.

        With `merges` all open nodes are roots, and equal rows of all blocks of a task are sent as one.
        """
        depth, bootstrap = self.getOrDefault("maxDepth"), self.getOrDefault("bootstrap")
        read = self._reader(tops, draws, open_nodes)
        keys = {(t, node): v for t, nodes in open_nodes.items() for node, v in nodes.items()}

        def send(batches):
            for _, block in blocks(batches, np.int32):
                for t, node, weight, here in read(block):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t]), pa.array([node]), *(pa.array([v.tobytes()], pa.binary()) for v in (
                            block.y[here], weight, block.x[here].T))], names=["tree", "node", "y", "n", "x"])

        def send_merged(batches):
            def times(row, t):
                return times_drawn(row, draws[t]) if bootstrap else np.ones(len(row), np.int64)

            trees = sorted(open_nodes)
            for part in in_blocks(Weighed.of_block(block, times, trees, len(DRAWN)) for _, block in blocks(batches, np.int32)):
                for t, w in zip(trees, part.w):
                    here = np.flatnonzero(w)
                    if len(here):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t]), pa.array([0]), *(pa.array([v.tobytes()], pa.binary()) for v in (
                                part.y[here], w[here].astype(np.int64), part.x[here].T))], names=["tree", "node", "y", "n", "x"])

        def finish(table: pa.Table) -> pa.Table:
            t, node = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            y, weight = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(c)]) for c, kind in ((2, np.int32), (3, np.int64)))
            x = np.concatenate([np.frombuffer(v.as_buffer()).reshape(width, -1) for v in table.column(4)], axis=1).T
            code, first = distinct(x, y)  # equal rows of several blocks
            weight = np.bincount(code, weight, len(first)).astype(np.int64)
            x, y = x[first], y[first]
            key, level = keys[t, node]
            grown = grow(x, y, weight, key, max(depth - level, 0), classes, looks)
            parts = {k: [v.tobytes()] for k, v in grown.arrays().items()}
            return pa.table({"tree": [t], "node": [node]} | parts | {"gains": [grown.gains.tobytes()]})

        trees = {t: top.arrays() | {"gains": top.gains.copy()} for t, top in tops.items()}
        if keys:
            spark = rows.sparkSession
            parts = min(len(keys), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
            sent = _few_tasks(rows).mapInArrow(send_merged, _SENT) if merges else rows.mapInArrow(send, _SENT)
            branches = sent \
                .repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(finish, f"tree long, node long, {_NODES}")
            pieces = {t: [] for t in trees}
            for r in sorted(branches.collect(), key=lambda r: (r["tree"], r["node"])):
                pieces[r["tree"]].append(r)
            for t, own in pieces.items():
                trees[t] = _joined(trees[t], own, classes)
        return [trees[t] for t in sorted(trees)]


def _few_tasks(rows: DataFrame) -> DataFrame:
    """The blocks in as many tasks as there are cores, so that a task brings many of them together."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _joined(top: dict, pieces: list, classes: int) -> dict:
    """A tree with branches in the place of some of its leaves: a branch's root takes the leaf's place."""
    parts = {k: [top[k].copy()] for k in _KINDS}
    parts["chance"][0] = parts["chance"][0].reshape(-1, classes)
    gains, size = top["gains"].copy(), len(top["feature"])
    for r in pieces:
        own = {k: np.frombuffer(r[k], kind).copy() for k, kind in _KINDS.items()}
        own["chance"] = own["chance"].reshape(-1, classes)
        inner = own["feature"] >= 0
        for side in ("left", "right"):  # the root is dropped: node i of the branch becomes node size + i - 1
            own[side][inner] += size - 1
        for k in _KINDS:
            parts[k][0][r["node"]] = own[k][0]
            parts[k].append(own[k][1:])
        gains += np.frombuffer(r["gains"])
        size += len(inner) - 1
    return {k: np.concatenate(v) for k, v in parts.items()} | {"gains": gains}


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        spark = SparkSession.getActiveSession()
        rows = [(i, *[bytearray(t[k].tobytes()) for k in [*_KINDS, "gains"]]) for i, t in enumerate(self.instance.trees)]
        spark.createDataFrame(rows, f"tree int, {_NODES}").write.parquet(f"{path}/trees")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> "RandomForestModel":
        model = super().load(path)
        classes = model.getOrDefault("classes")
        for r in SparkSession.getActiveSession().read.parquet(f"{path}/trees").orderBy("tree").collect():
            tree = {k: np.frombuffer(r[k], kind) for k, kind in (_KINDS | {"gains": np.float64}).items()}
            model.trees.append(tree | {"chance": tree["chance"].reshape(-1, classes)})
        return model


class RandomForestModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """The trees as arrays per node. They travel with the tasks that score; a stored model keeps them as a table."""

    width = _param("width", "number of features", TypeConverters.toInt)
    classes = _param("classes", "number of classes", TypeConverters.toInt)

    def __init__(self, featuresCol=None, width=None, classes=None, trees=()):
        super().__init__()
        self._set(**{k: v for k, v in dict(featuresCol=featuresCol, width=width, classes=classes).items() if v is not None})
        self.trees = list(trees)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    @property
    def depths(self) -> list[int]:
        """Levels of splits of every tree."""
        out = []
        for t in self.trees:
            depth, front = 0, np.zeros(1, np.int64)
            while True:
                front = front[t["feature"][front] >= 0]
                if not len(front):
                    break
                depth, front = depth + 1, np.concatenate([t["left"][front], t["right"][front]])
            out.append(depth)
        return out

    @property
    def featureImportances(self) -> DenseVector:
        """Mean over the trees of every feature's share of the impurity that the tree's splits removed."""
        shares = [t["gains"] / t["gains"].sum() for t in self.trees if t["gains"].sum() > 0]
        total = np.sum(shares, axis=0) if shares else np.zeros(self.getOrDefault("width"))
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        width, classes, trees = self.getOrDefault("width"), self.getOrDefault("classes"), self.trees

        def chance_of(x: np.ndarray) -> np.ndarray:
            total = np.zeros((len(x), classes))
            for t in trees:
                total += t["chance"][node_of(t, x)]
            return total / max(len(trees), 1)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def chances(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = {}
            for features in parts:
                x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
                found = looked_up(x, known, KNOWN_ROWS, chance_of)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * classes), pa.array(found.ravel()))

        p = chances(vector_to_array(quoted(self.getFeaturesCol())))
        out = df.withColumn("probability", p)
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("probability"))
