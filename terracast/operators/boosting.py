"""Boosted trees of MLlib, grown from histograms of packed bins.

Same trees as GBTRegressor / GBTClassifier: their split candidates, row and input draws, gains, ties and pruning, and the
result is MLlib's own model. Only the passes over the training rows differ: rows are binned once into chunks of one byte a value, a
task reads its chunks one after another and sends one histogram a pass, and a row's score is carried on instead of being
worked out from boxed values. Tree by tree the last bits follow the order of summing, as they do in MLlib.

Numeric inputs without weights only, which is what `models.assembler` makes.
"""
from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from decimal import Decimal, localcontext
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# tasks get this module's functions by value: executors need numpy and pyarrow only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows of a chunk at most; a chunk is what a task holds at a time
CHUNK_ROWS = 65_536
#: below this share of rows in open nodes the others are left out before counting
DENSE = 0.6
#: draws of one lane of the generator
LANE = 32
#: histograms of more tasks than this are added up on the way to the driver
DIRECT = 64
#: scores are worked out anew from the binned rows after so many trees, so that no chain of stored scores grows longer
CHAIN = 50
MIN_GAIN = -sys.float_info.max
MASK = (1 << 64) - 1


# ---------------------------------------------------------------- random draws of MLlib
def xorshift(s):
    """Next state of Spark's XORShiftRandom, of a Python int or an array of uint64."""
    wide = isinstance(s, int)
    u = (lambda k: k) if wide else np.uint64
    s = s ^ (s << u(21))
    if wide:
        s &= MASK
    s = s ^ (s >> u(35))
    s = s ^ (s << u(4))
    return s & MASK if wide else s


def uniform(s: int) -> tuple[float, int]:
    """nextDouble and the state after it."""
    a = xorshift(s)
    b = xorshift(a)
    return (((a & ((1 << 26) - 1)) << 27) + (b & ((1 << 27) - 1))) * 2.0 ** -53, b


def mapped(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States under a linear map given by the images of the 64 bits."""
    bits = (states[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return np.bitwise_xor.reduce(bits * matrix, axis=1)


def lane_map() -> np.ndarray:
    """The map from a lane's first state to the next lane's."""
    m = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(2 * LANE):
        m = xorshift(m)
    return m


def uniforms(seed: int, n: int, jump: np.ndarray) -> np.ndarray:
    """The first n draws of nextDouble: lanes start where the generator would be, and go on side by side."""
    lanes, states = -(-n // LANE), np.array([seed], dtype=np.uint64)
    while len(states) < lanes:
        states, jump = np.concatenate([states, mapped(jump, states)]), mapped(jump, jump)
    states = states[:lanes]
    out = np.empty((lanes, LANE))
    for k in range(LANE):
        a = xorshift(states)
        states = xorshift(a)
        high = (a & np.uint64((1 << 26) - 1)) << np.uint64(27)
        out[:, k] = (high + (states & np.uint64((1 << 27) - 1))).astype(np.float64) * 2.0 ** -53
    return out.ravel()[:n]


class JavaRandom:
    """java.util.Random, as far as nextLong."""

    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _bits(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        v = self.s >> 16
        return v - (1 << 32) if v >> 31 else v

    def long(self) -> int:
        v = ((self._bits() << 32) + self._bits()) & MASK
        return v - (1 << 64) if v >> 63 else v


def reservoir(n: int, k: int, state: int) -> list[int]:
    """k of n inputs, drawn as SamplingUtils.reservoirSampleAndCount does."""
    chosen = list(range(k))
    for item in range(k, n):
        d, state = uniform(state)
        at = int(d * (item + 1))
        if at < k:
            chosen[at] = item
    return chosen


# ---------------------------------------------------------------- e^x of the JVM
# fixed values: the constants of java.lang.Math.exp on x86-64 (64 parts of a power of two, polynomial of degree 6)
PARTS, STEP_HIGH, STEP_LOW = (float.fromhex(v) for v in ("0x1.71547652b82fep+6", "0x1.62e42fefap-7", "0x1.cf79abc9e3b39p-46"))
C2, C3, C4, C5, C6 = (float.fromhex(v) for v in ("0x1.ffffffffffffep-2", "0x1.5555555548ba1p-3", "0x1.55555555b9e25p-5", "0x1.11115c090cf0fp-7", "0x1.6c15ce3289860p-10"))


def power_table() -> tuple[np.ndarray, np.ndarray]:
    """2^(j/64) cut off to a double, and the share of it that was cut off."""
    high, low = [], []
    with localcontext() as exact:
        exact.prec = 60
        for j in range(64):
            t = Decimal(2) ** (Decimal(j) / 64)
            h = float(t)
            h = math.nextafter(h, 0.0) if Decimal(h) > t else h
            high.append(h)
            low.append(float(t / Decimal(h) - 1))
    return np.array(high), np.array(low)


HIGH, LOW = power_table()


def java_exp(x: np.ndarray) -> np.ndarray:
    """e^x to the last bit as MLlib's log loss has it: numpy's differs in some of the last bits, which would decide between equal splits."""
    inner = np.abs(x) < 700.0
    z = np.where(inner, x, 0.0)
    shift = 6755399441055744.0
    m = (z * PARTS + shift) - shift
    k = m.astype(np.int64)
    r = (z - m * STEP_HIGH) - m * STEP_LOW
    r2 = r * r
    r3 = r * r2
    p = (r3 * (C3 + C4 * r) + ((r + LOW[k & 63]) + (r3 * r2) * (C5 + C6 * r))) + r2 * C2
    t = np.ldexp(HIGH[k & 63], k >> 6)
    with np.errstate(over="ignore", under="ignore"):
        return np.where(inner, p * t + t, np.exp(x))


# ---------------------------------------------------------------- in tasks
def binned_chunks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], classes: bool) -> Iterator[pa.RecordBatch]:
    """Chunks of one partition: its number, rows, bins of every input as bytes, labels."""
    kind = np.uint8 if max([len(c) for c in cuts] + [0]) < 256 else np.uint16

    def chunk(part, x, y):
        if not (np.isfinite(y).all() and not np.isnan(x).any()):
            raise ValueError("a label or an input of a training row is missing")
        if classes and not ((y == 0) | (y == 1)).all():
            raise ValueError("labels of events must be 0 or 1")
        bins = np.stack([np.searchsorted(c, x[:, f]).astype(kind) for f, c in enumerate(cuts)])
        y = y * 2 - 1 if classes else y
        return pa.RecordBatch.from_pydict({"part": [part], "n": [len(y)], "bins": [bins.tobytes()], "y": [y.tobytes()]},
                                          pa.schema([("part", pa.int32()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary())]))

    part, xs, ys, held = None, [], [], 0
    for b in batches:
        if not len(b):
            continue
        part = b.column(0)[0].as_py()
        if b.column(2).null_count or b.column(1).null_count:
            raise ValueError("a label or an input of a training row is missing")
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(cuts))
        y = b.column(2).to_numpy(zero_copy_only=False)
        while len(y):
            take = min(len(y), CHUNK_ROWS - held)
            xs.append(x[:take])
            ys.append(y[:take])
            held, x, y = held + take, x[take:], y[take:]
            if held == CHUNK_ROWS:
                yield chunk(part, np.concatenate(xs), np.concatenate(ys))
                xs, ys, held = [], [], 0
    if held:
        yield chunk(part, np.concatenate(xs), np.concatenate(ys))


def placed(bins: np.ndarray, cuts: list[tuple[int, int, int]], nodes: int) -> np.ndarray:
    """Node of every row: from the root (1) through the inner nodes (id, input, last bin of the left side), parents first."""
    kind = np.uint8 if nodes <= 256 else np.uint16 if nodes <= 65_536 else np.int64
    at = np.ones(bins.shape[1], dtype=kind)
    for node, feature, last in cuts:
        here = at == node
        at += here * kind(node) + (here & (bins[feature] > last))
    return at


def counted(bins: np.ndarray, target: np.ndarray, base: np.ndarray, size: int, width: int) -> np.ndarray:
    """Rows, sum and sum of squares by input and cell (base of the row's node + bin); a base of `size` is no open node."""
    live = base != size
    if live.mean() < DENSE:
        at = np.flatnonzero(live)
        bins, target, base = bins[:, at], target[at], base[at]
    square = target * target
    out = np.empty((3, len(bins), size))
    cell = np.empty(len(base), dtype=np.int64)
    for f in range(len(bins)):
        np.add(base, bins[f], out=cell)
        out[0, f] = np.bincount(cell, minlength=size + width)[:size]
        out[1, f] = np.bincount(cell, weights=target, minlength=size + width)[:size]
        out[2, f] = np.bincount(cell, weights=square, minlength=size + width)[:size]
    return out


def gradient(y: np.ndarray, score: np.ndarray, classes: bool) -> np.ndarray:
    """What the next tree is fitted to: MLlib's squared error and log loss."""
    if not classes:
        return 2.0 * (y - score)
    return 4.0 * y / (1.0 + java_exp(2.0 * y * score))


def scored(bins: np.ndarray, score: np.ndarray, trees: list, nodes: int) -> np.ndarray:
    """Scores after some more trees: (inner nodes, value by node, weight)."""
    for cuts, values, weight in trees:
        score = score + values[placed(bins, cuts, nodes)] * weight
    return score


# ---------------------------------------------------------------- growing
class Node:
    """A node in growth: its rows' (count, sum, sum of squares) and, once split, its cut."""

    def __init__(self, stats: tuple[float, float, float]):
        self.stats, self.valid, self.cut, self.gain, self.impurity = stats, True, None, 0.0, variance(*stats)

    @property
    def value(self) -> float:
        return 0.0 if self.stats[0] == 0 else self.stats[1] / self.stats[0]


def variance(count, total, squares):
    return 0.0 if count == 0 else (squares - total * total / count) / count


def best_cuts(sums: np.ndarray, splits: np.ndarray, min_rows: int, parents: list[Node | None], subsets: list[list[int]], min_gain: float) -> list[tuple]:
    """For each node (its own stats if any, or None for a root): stats, gain, cut (input, last bin), left and right stats; cut None without a valid one.

    sums: (3, inputs, nodes, bins).
    """
    run = np.cumsum(sums, axis=3)
    every = np.arange(len(splits))
    total = run[:, every, :, splits]  # (inputs, 3, nodes)
    total = total.transpose(1, 0, 2)[:, :, :, None]
    left = run[..., : max(int(splits.max(initial=0)), 1)]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = lambda s: np.where(s[0] == 0, 0.0, (s[2] - s[1] * s[1] / s[0]) / s[0])
        lw, rw = left[0] / (left[0] + right[0]), right[0] / (left[0] + right[0])
        lost = lw * spread(left), rw * spread(right)
    bad = (left[0] < min_rows) | (right[0] < min_rows)
    none = np.arange(left.shape[3])[None, :] >= splits[:, None]
    out = []
    for k, (parent, subset) in enumerate(zip(parents, subsets, strict=True)):
        usable = [f for f in subset if splits[f]]
        if parent is None:
            f = usable[0] if usable else subset[0]
            parent = Node(tuple(float(v) for v in (left[:, f, k, 0] + right[:, f, k, 0] if usable else total[:, f, k, 0])))
        if not usable:
            out.append((parent, MIN_GAIN, None, None, None))
            continue
        gain = parent.impurity - lost[0][usable, k] - lost[1][usable, k]
        gain = np.where(none[usable], -np.inf, np.where(bad[usable, k] | ~(gain >= min_gain), MIN_GAIN, gain))
        last = gain.argmax(axis=1)
        top = gain[np.arange(len(usable)), last]
        i = int(top.argmax())
        f, s, g = usable[i], int(last[i]), float(top[i])
        if g == MIN_GAIN:
            out.append((parent, g, None, None, None))
        else:
            out.append((parent, g, (f, s), tuple(float(v) for v in left[:, f, k, s]), tuple(float(v) for v in right[:, f, k, s])))
    return out


class _Grower:
    """One fit: split candidates from MLlib, chunks of binned rows, trees one after another."""

    def __init__(self, estimator, dataset: DataFrame, classes: bool):
        self.spark, self.classes, self.est = dataset.sparkSession, classes, estimator
        sc = self.sc = self.spark.sparkContext
        jvm = self.jvm = sc._jvm
        estimator._transfer_params_to_java()
        java = estimator._java_obj
        module = lambda name: getattr(getattr(jvm.java.lang.Class.forName(f"{name}$"), "getField")("MODULE$"), "get")(None)
        tree = jvm.org.apache.spark.ml.tree.impl
        features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
        rows = dataset.select(F.col(features), F.col(label).cast("double").alias(label))
        instances = module("org.apache.spark.ml.util.DatasetUtils").extractInstances(java, rows._jdf, jvm.scala.Option.empty())
        kind = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
        strategy = java.getOldBoostingStrategy(jvm.PythonUtils.toScalaMap({}), kind).treeStrategy()
        self.meta = tree.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, estimator.getFeatureSubsetStrategy())
        self.seed = estimator.getSeed()
        found = module("org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, self.meta, self.seed)
        self.cuts = [np.array([s.threshold() for s in of]) for of in found]
        self.splits = np.array([len(c) for c in self.cuts])
        self.width = int(self.splits.max(initial=0)) + 1
        self.hash = module("org.apache.spark.util.random.XORShiftRandom").hashSeed
        self.depth, self.rate = estimator.getMaxDepth(), estimator.getSubsamplingRate()
        self.nodes, self.jump = 2 << self.depth, lane_map()
        cuts = self.cuts
        packed = rows.select(F.spark_partition_id().alias("part"), vector_to_array(features).alias("x"), label)
        packed = packed.mapInArrow(lambda batches: binned_chunks(batches, cuts, classes), "part int, n int, bins binary, y binary").rdd
        inputs, dtype = len(cuts), np.uint8 if self.width <= 256 else np.uint16
        unpack = lambda r: (r.part, np.frombuffer(r.bins, dtype=dtype).reshape(inputs, r.n), np.frombuffer(r.y))
        parts = packed.getNumPartitions()
        tasks = sc.defaultParallelism
        self.base = (packed.coalesce(tasks) if parts > tasks else packed).map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
        # draws of a partition start from its number
        self.parts = parts

    def state_of(self, seed: int) -> int:
        return self.hash(seed) & MASK

    def rows_of_tree(self, m: int, trees: list, before):
        """Chunks (part, bins, labels, scores, target, rows drawn) that tree m is fitted to."""
        seeds = [self.state_of(self.seed + m + p + 1) for p in range(self.parts)] if self.rate < 1.0 else None
        rate, jump, nodes, classes = self.rate, self.jump, self.nodes, self.classes

        def of_partition(chunks):
            part, before = None, 0
            for c in chunks:
                n = len(c[2])
                # a partition of several chunks goes on drawing where its last chunk stopped
                before = before if c[0] == part else 0
                kept = uniforms(seeds[c[0]], before + n, jump)[before:] < rate if seeds else np.ones(n, dtype=bool)
                part, before = c[0], before + n
                score = scored(c[1], np.zeros(n) if len(c) == 3 else c[3], trees, nodes)
                yield (*c[:3], score, gradient(c[2], score, classes) if m else c[2], kept)

        return before.mapPartitions(of_partition, True).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, rows, cuts: list, slots: dict[int, int]) -> np.ndarray:
        """Histograms of the open nodes over all tasks: (3, inputs, nodes, bins)."""
        width, nodes, inputs = self.width, self.nodes, len(self.cuts)
        size = len(slots) * width
        to_base = np.full(nodes, size, dtype=np.int64)
        for node, k in slots.items():
            to_base[node] = k * width

        def of_partition(chunks):
            out, first = None, 0
            for part, bins, _, _, target, kept in chunks:
                base = to_base[placed(bins, cuts, nodes)]
                base[~kept] = size
                got = counted(bins, target, base, size, width)
                out, first = (got, part) if out is None else (out + got, first)
            if out is not None:
                yield first, out

        each = rows.mapPartitions(of_partition)
        if each.getNumPartitions() > DIRECT:
            total = each.values().treeReduce(lambda a, b: a + b)
        else:
            # in order of the partitions, as the last bits depend on it
            total = reduce(lambda a, b: a + b, (got for _, got in sorted(each.collect(), key=lambda r: r[0])))
        return total.reshape(3, inputs, len(slots), width)

    def tree(self, m: int, rows) -> dict[int, Node]:
        """Nodes of one tree by id (children of i: 2i and 2i + 1), grown in MLlib's order."""
        rng, meta, n = JavaRandom(self.seed + m), self.meta, len(self.cuts)
        per_node, limit = meta.numFeaturesPerNode(), self.est.getMaxMemoryInMB() * 1024 * 1024
        min_rows, min_gain = meta.minInstancesPerNode(), self.est.getMinInfoGain()
        grown: dict[int, Node] = {}
        stack, inner = [1], []
        while stack:
            group, subsets, used = [], [], 0
            while stack:
                subset = reservoir(n, per_node, self.state_of(rng.long())) if per_node < n else list(range(n))
                need = 3 * 8 * int(sum(self.splits[f] + 1 for f in subset))
                if used and used + need > limit:
                    break
                group.append(stack.pop(0))
                subsets.append(subset)
                used += need
            sums = self.sums(rows, inner, {node: k for k, node in enumerate(group)})
            for node, (own, gain, cut, left, right) in zip(group, best_cuts(sums, self.splits, min_rows, [grown.get(g) for g in group], subsets, min_gain), strict=True):
                grown[node] = own
                own.gain, own.valid = gain, cut is not None
                if gain <= 0:
                    continue
                own.cut = cut
                inner.append((node, *cut))
                last = node.bit_length() == self.depth
                for child, stats in ((2 * node, left), (2 * node + 1, right)):
                    grown[child] = Node(stats)
                    if not last and abs(grown[child].impurity) >= 2.0 ** -52:
                        stack.insert(0, child)
            inner.sort()
        return grown

    def grow(self) -> list[tuple[dict[int, Node], float]]:
        out, told, rows = [], [], None
        try:
            for m in range(self.est.getMaxIter()):
                anew = rows is None or m % CHAIN == 0
                new = self.rows_of_tree(m, told if anew else told[-1:], self.base if anew else rows)
                grown = self.tree(m, new)
                if rows is not None:
                    rows.unpersist()
                rows, weight = new, 1.0 if m == 0 else self.est.getStepSize()
                values = np.zeros(self.nodes)
                for node, k in grown.items():
                    values[node] = k.value
                told.append((sorted((node, *k.cut) for node, k in grown.items() if k.cut), values, weight))
                out.append((grown, weight))
        finally:
            if rows is not None:
                rows.unpersist()
            self.base.unpersist()
        return out

    def java_trees(self, trees: list[tuple[dict[int, Node], float]]):
        """MLlib's trees: leaves of one value under one node become a leaf."""
        jvm, gateway = self.jvm, self.sc._gateway
        ml, old = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity
        copy = jvm.java.util.Arrays.copyOfRange
        flat = np.array([k.stats for grown, _ in trees for k in grown.values()], dtype=">f8").ravel()
        stats = gateway.new_array(jvm.double, len(flat))
        jvm.java.nio.ByteBuffer.wrap(flat.tobytes()).asDoubleBuffer().get(stats)
        cuts: dict[tuple, object] = {}
        place = 0

        def build(node: int):
            """(JVM node, value if it is a leaf)"""
            own, at = grown[node], where[node]
            calc = old.VarianceCalculator(copy(stats, 3 * at, 3 * at + 3), int(own.stats[0]))
            if own.cut:
                (left, a), (right, b) = build(2 * node), build(2 * node + 1)
                if a is None or b is None or a != b:
                    if own.cut not in cuts:
                        cuts[own.cut] = ml.tree.ContinuousSplit(own.cut[0], float(self.cuts[own.cut[0]][own.cut[1]]))
                    return ml.tree.InternalNode(own.value, own.impurity, own.gain, left, right, cuts[own.cut], calc), None
                return ml.tree.LeafNode(a, own.impurity, calc), a
            return ml.tree.LeafNode(own.value, own.impurity if own.valid else -1.0, calc), own.value

        models = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
        weights = gateway.new_array(jvm.double, len(trees))
        for i, (grown, weight) in enumerate(trees):
            where = {node: place + k for k, node in enumerate(grown)}
            place += len(grown)
            models[i] = ml.regression.DecisionTreeRegressionModel(build(1)[0], len(self.cuts))
            weights[i] = weight
        return models, weights


class BoostedRegressor(GBTRegressor):
    """GBTRegressor with its model, fitted by histograms."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        g = _Grower(self, dataset, classes=False)
        trees, weights = g.java_trees(g.grow())
        java = g.jvm.org.apache.spark.ml.regression.GBTRegressionModel(self.uid, trees, weights, len(g.cuts))
        return self._copyValues(GBTRegressionModel(java))


class BoostedClassifier(GBTClassifier):
    """GBTClassifier with its model, fitted by histograms."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        g = _Grower(self, dataset, classes=True)
        trees, weights = g.java_trees(g.grow())
        java = g.jvm.org.apache.spark.ml.classification.GBTClassificationModel(self.uid, trees, weights, len(g.cuts), 2)
        return self._copyValues(GBTClassificationModel(java))
