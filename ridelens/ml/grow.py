"""Forests and boosted trees on many rows.

A pass of Spark's forest sends the statistics of every open node of every tree from every task. On millions of rows the
trees have thousands of nodes a level, and those statistics are far more than the rows. Here rows go to the trees instead:

1. Features are read as bin numbers (the thresholds follow Spark's rule, from all values, not from a sample of the rows).
   Neighbouring features that are never set together, as the columns of a one-hot block, share one number a row.
2. Nodes with more than ``TASK_ROWS`` rows are split from bin statistics of all tasks, a level of all trees in a pass.
3. Rows of a smaller node go to one task, which grows everything below it. Each row goes there once a tree.

A tree is the one Spark grows: Poisson weights, variance gain, a random part of the features at every node, the same limits.
Weights depend on seed, tree and block only, so a task that runs again gets the same rows. Boosted trees need all rows for
each tree; up to ``BOOST_CODES`` bin numbers one task holds them. The functions that run in tasks are sent by value.
"""

from __future__ import annotations

import json
import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# rows of a block; rows (counted with their weights) of a node that one task grows, and of all nodes that a task gets;
# bytes that the rows of concurrently grown trees take on their way; bytes of bin statistics held at a time, in a pass
# and in a task; values of a feature that are counted one by one; bin numbers that a boosting task holds
BLOCK_ROWS, TASK_ROWS, SENT_BYTES = 65_536, 4_000_000, 4_000_000_000
PASS_BYTES, BATCH_BYTES, COUNTED_VALUES, BOOST_CODES = 64_000_000, 4_000_000, 10_000, 100_000_000
MAX_CODES = 60_000


# ---------------------------------------------------------------------------
# bins
# ---------------------------------------------------------------------------
def thresholds_of(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds between the sorted values: all midpoints, or, with too many values, those nearest to equal shares
    of the rows (Spark's rule for a continuous feature)."""
    mid = values[:-1] + (values[1:] - values[:-1]) / 2.0
    if len(values) <= max_bins:
        return mid
    below, stride = np.cumsum(counts)[:-1], counts.sum() / max_bins
    want = stride * np.arange(1, max_bins)
    at = np.clip(np.searchsorted(below, want), 1, len(below) - 1)
    at = np.where(np.abs(below[at - 1] - want) <= np.abs(below[at] - want), at - 1, at)
    return mid[np.unique(at)]


class Layout:
    """Where a row's bins lie. ``thresholds`` per feature; ``next_set[f]`` is the smallest feature that is set (not 0)
    next after ``f`` in some row. A slot holds neighbouring features of which no row has two: 0 for none, else a code
    for the feature and its bin; or the bins of a single feature. A split is (feature, bin): bins up to it go left."""

    def __init__(self, thresholds: list, next_set):
        self.thresholds = [np.asarray(t, float) for t in thresholds]
        bins = [len(t) + 1 for t in self.thresholds]
        self.slots: list[list[tuple[int, int]]] = []  # (feature, its first code)
        start, sizes, bound = 0, [], 0
        for f in range(len(bins)):
            # the slot's features lie before the next set one of each of them
            if f == 0 or f >= bound or start + bins[f] > MAX_CODES:
                self.slots.append([])
                sizes.append(0)
                start, bound = 1, len(bins)
            self.slots[-1].append((f, start))
            start += bins[f]
            bound = min(bound, int(next_set[f]))
            sizes[-1] = start
        for k, slot in enumerate(self.slots):
            if len(slot) == 1:
                self.slots[k], sizes[k] = [(slot[0][0], 0)], bins[slot[0][0]]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.size, self.features = int(self.base[-1]), len(bins)
        self.dtype = np.uint8 if max(sizes) <= 256 else np.uint16
        rows = []
        for k, slot in enumerate(self.slots):
            for f, first in slot:
                zero = int(np.searchsorted(self.thresholds[f], 0.0))
                for t in range(bins[f] - 1):
                    rest = len(slot) > 1 and t >= zero  # rows with code of another feature have bin ``zero`` here
                    # a code goes right if it is less than ``width`` codes above the cut (as 16 bit numbers)
                    width = bins[f] - t - 1 if rest else 65_536 - (t + 1)
                    rows.append((f, t, k, first, first + t + 1, first + bins[f], rest, width))
        c = np.array(rows, np.int64).reshape(-1, 8)
        self.feature, self.bin, self.slot = c[:, 0], c[:, 1], c[:, 2]
        offset = self.base[self.slot]
        self.lo, self.cut, self.hi, self.rest = c[:, 3] + offset, c[:, 4] + offset, c[:, 5] + offset, c[:, 6].astype(float)
        self.above, self.width = c[:, 4].astype(np.uint16), c[:, 7].astype(np.uint16)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.slots)), self.dtype)
        for k, slot in enumerate(self.slots):
            for f, first in slot:
                if len(slot) == 1:
                    out[:, k] = np.searchsorted(self.thresholds[f], x[:, f])
                else:
                    at = np.flatnonzero(x[:, f])
                    out[at, k] = first + np.searchsorted(self.thresholds[f], x[at, f])
        return out

    def goes_right(self, codes: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Whether each row goes right at its split."""
        m = codes.shape[1]
        code = codes.reshape(-1)[np.arange(0, len(codes) * m, m) + self.slot[split]].astype(np.uint16)
        return (code - self.above[split]) < self.width[split]

    def statistics(self, codes: np.ndarray, node: np.ndarray | None, nodes: int, w: np.ndarray | None, wy: np.ndarray) -> tuple:
        """Sum of the weights and of the weighted labels for every (node, code); without ``w`` every weight is 1."""
        hn, hs = np.zeros((nodes, self.size)), np.zeros((nodes, self.size))
        for at in range(0, len(codes), BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            number, lo, count = None, 0, 1
            if node is not None:
                lo = int(node[part].min())
                number, count = node[part] - lo, int(node[part].max()) - lo + 1
            for k, code in enumerate(np.ascontiguousarray(codes[part].T)):
                size, own = int(self.base[k + 1] - self.base[k]), slice(self.base[k], self.base[k + 1])
                key = code.astype(np.int64) if number is None else number * size + code
                hs[lo:lo + count, own] += np.bincount(key, wy[part], count * size).reshape(count, size)
                hn[lo:lo + count, own] += np.bincount(key, None if w is None else w[part], count * size).reshape(count, size)
        return hn, hs


def best_splits(lay: Layout, hn, hs, tn, ts, allowed, least: int, min_gain: float) -> tuple:
    """Per node the split with the largest gain of variance (-1: none) and its left side's weights and labels."""
    nodes = len(tn)
    split, ln, ls = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes)
    if not len(lay.feature):
        return split, ln, ls
    step = max(1, 400_000 // len(lay.feature))
    for at in range(0, nodes, step):
        part = slice(at, at + step)

        def left(h, t):
            c = np.zeros((len(h), lay.size + 1))
            np.cumsum(h, axis=1, out=c[:, 1:])
            lo = c[:, lay.lo]
            return c[:, lay.cut] - lo + lay.rest * (t[:, None] - c[:, lay.hi] + lo)

        n, s = tn[part], ts[part]
        nl, sl = left(hn[part], n), left(hs[part], s)
        nr, sr = n[:, None] - nl, s[:, None] - sl
        ok = (nl >= least) & (nr >= least)
        if allowed is not None:
            ok &= allowed[part][:, lay.feature]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(ok, sl * sl / nl + sr * sr / nr, -np.inf)
        best, i = score.argmax(axis=1), np.arange(len(n))
        own = s * s / n
        gain = score[i, best] - own
        # equal labels leave the rounding of the sums as their gain
        good = (gain > 1e-12 * own) & (gain >= min_gain * n) & (gain > 0)
        split[part] = np.where(good, best, -1)
        ln[part], ls[part] = nl[i, best], sl[i, best]
    return split, ln, ls


def some_features(rng, nodes: int, features: int, take: int):
    """A random ``take`` of the features for each node."""
    if take >= features:
        return None
    r = rng.random((nodes, features), np.float32)
    return r <= np.partition(r, take - 1, axis=1)[:, take - 1:take]


# ---------------------------------------------------------------------------
# one tree in memory
# ---------------------------------------------------------------------------
class Tree:
    """Nodes as arrays: ``split`` (-1: a leaf), ``left`` child (the right one is the next), ``value``."""

    def __init__(self, split=(-1,), left=(0,), value=(0.0,)):
        self.split, self.left, self.value = np.array(split, np.int32), np.array(left, np.int32), np.array(value, float)

    def add(self, node, split, left_values, right_values) -> int:
        """Splits of leaves; the children get the next numbers, in pairs. Returns the first one."""
        first, k = len(self.split), len(node)
        self.split[node], self.left[node] = split, first + 2 * np.arange(k)
        self.split = np.concatenate([self.split, np.full(2 * k, -1, np.int32)])
        self.left = np.concatenate([self.left, np.zeros(2 * k, np.int32)])
        self.value = np.concatenate([self.value, np.column_stack([left_values, right_values]).reshape(-1)])
        return first

    def graft(self, node: int, other: Tree) -> None:
        """``other`` in the place of a leaf."""
        first = len(self.split) - 1  # its root takes the leaf's number, its others follow
        left = np.where(other.split >= 0, other.left + first, 0)
        self.split[node], self.left[node], self.value[node] = other.split[0], left[0], other.value[0]
        self.split = np.concatenate([self.split, other.split[1:]])
        self.left = np.concatenate([self.left, left[1:].astype(np.int32)])
        self.value = np.concatenate([self.value, other.value[1:]])

    def leaf_of(self, codes: np.ndarray, lay: Layout) -> np.ndarray:
        node = np.zeros(len(codes), np.int32)
        at = np.arange(len(codes)) if self.split[0] >= 0 else np.array([], int)
        while len(at):
            here = node[at]
            node[at] = self.left[here] + lay.goes_right(codes if len(at) == len(codes) else codes[at], self.split[here])
            at = at[self.split[node[at]] >= 0]
        return node


def grow(codes, y, w, lay: Layout, depth: int, take: int, least: int, min_gain: float, rng) -> Tree:
    """A tree of at most ``depth`` levels of splits on rows with bins, labels and weights (None: all 1).

    Nodes are taken in batches whose statistics fit in ``BATCH_BYTES``. Rows lie in the order of their nodes; of two
    children the smaller one is counted, the other is the difference to the node.
    """
    tree = Tree()
    wy = y if w is None else w * y
    total = (float(len(y)) if w is None else float(w.sum()), float(wy.sum()))
    tree.value[0] = total[1] / total[0] if total[0] else 0.0
    hn, hs = lay.statistics(codes, None, 1, w, wy)
    one = np.array
    stack = [(depth, one([0]), one([len(y)]), codes, w, wy, hn, hs, one([total[0]]), one([total[1]]))]
    while stack:
        depth, node, size, codes, w, wy, hn, hs, tn, ts = stack.pop()
        if depth <= 0 or not len(node):
            continue
        if len(node) > 1 and len(node) * lay.size * 48 > BATCH_BYTES:
            half = len(node) // 2
            cut = size[:half].sum()
            for a, b in ((slice(half, None), slice(cut, None)), (slice(None, half), slice(None, cut))):
                stack.append((depth, node[a], size[a], codes[b], None if w is None else w[b], wy[b], hn[a], hs[a],
                              tn[a], ts[a]))
            continue
        split, ln, ls = best_splits(lay, hn, hs, tn, ts, some_features(rng, len(node), lay.features, take), least, min_gain)
        ok = split >= 0
        k = int(ok.sum())
        if not k:
            continue
        if k < len(node):
            rows = np.flatnonzero(np.repeat(ok, size))
            codes, wy, w = codes.take(rows, axis=0), wy[rows], None if w is None else w[rows]
            node, size, hn, hs, split, ln, ls, tn, ts = (v[ok] for v in (node, size, hn, hs, split, ln, ls, tn, ts))
        rn, rs = tn - ln, ts - ls
        first = tree.add(node, split, ls / ln, rs / rn)
        if depth == 1:
            continue
        right = lay.goes_right(codes, np.repeat(split, size))
        in_right = np.add.reduceat(right, np.cumsum(size) - size, dtype=np.int64)
        small_right = in_right * 2 < size
        # children: all left ones, then all right ones; a child is worth a look if it could be split
        size2 = np.concatenate([size - in_right, in_right])
        tn2, ts2 = np.concatenate([ln, rn]), np.concatenate([ls, rs])
        node2 = np.concatenate([first + 2 * np.arange(k), first + 2 * np.arange(k) + 1])
        open_ = tn2 >= 2 * max(least, 1)
        pair = open_[:k] | open_[k:]
        hn2, hs2 = np.zeros((2 * k, lay.size)), np.zeros((2 * k, lay.size))
        number = np.repeat(np.arange(k), size)
        rows = np.flatnonzero((right == small_right[number]) & pair[number])
        cn, cs = lay.statistics(codes.take(rows, axis=0), number[rows], k, None if w is None else w[rows], wy[rows])
        small = np.where(small_right, k, 0) + np.arange(k)
        large = np.where(small_right, 0, k) + np.arange(k)
        hn2[small], hs2[small], hn2[large], hs2[large] = cn, cs, hn - cn, hs - cs
        order = np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)])
        if not open_.all():
            order = order[np.repeat(open_, size2)]
            node2, size2, hn2, hs2, tn2, ts2 = (v[open_] for v in (node2, size2, hn2, hs2, tn2, ts2))
        stack.append((depth - 1, node2, size2, codes.take(order, axis=0), None if w is None else w[order], wy[order],
                      hn2, hs2, tn2, ts2))
    return tree


def boost(codes, y, lay: Layout, rounds: int, rate: float, depth: int, least: int, min_gain: float) -> list[tuple[float, Tree]]:
    """Boosted trees of the squared error as Spark grows them: the first on the labels, each further one on twice the
    rest, weighed by the learning rate."""
    out, rest = [], y.copy()
    rng = np.random.default_rng(0)
    for i in range(rounds):
        target = rest if i == 0 else 2.0 * rest
        tree = grow(codes, target, None, lay, depth, lay.features, least, min_gain, rng)
        weight = 1.0 if i == 0 else rate
        rest = rest - weight * tree.value[tree.leaf_of(codes, lay)]
        out.append((weight, tree))
    return out


# ---------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------
def _dense(column) -> np.ndarray:
    """Arrays of one length as a matrix whose columns lie together."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asfortranarray(flat.reshape(len(column), -1))


def feature_layout(train: DataFrame, features: str, max_bins: int) -> Layout:
    """Thresholds and slots from all rows: values are counted one by one, or, where a task finds more than
    ``COUNTED_VALUES`` of a feature, its quantiles are taken."""
    limit = COUNTED_VALUES

    def counted(batches):
        import pyarrow as pa

        seen, many, after, rows = {}, set(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _dense(b.column(0))
            rows += len(x)
            after = np.full(x.shape[1], x.shape[1], np.int64) if after is None else after
            r, c = np.nonzero(x)
            pair = r[1:] == r[:-1]
            np.minimum.at(after, c[:-1][pair], c[1:][pair])
            for f in range(x.shape[1]):
                if f in many:
                    continue
                held, v = seen.setdefault(f, {}), x[:, f]
                for value, n in zip(*(a.tolist() for a in np.unique(v[v != 0], return_counts=True)), strict=True):
                    held[value] = held.get(value, 0) + n
                if len(held) > limit:
                    many.add(f)
                    del seen[f]
        if after is None:
            return
        out = [(f, "next", float(a), 1) for f, a in enumerate(after.tolist())] + [(f, "many", 0.0, 1) for f in many]
        for f, held in seen.items():
            out += [(f, "value", v, n) for v, n in held.items()]
            if rows > sum(held.values()):
                out.append((f, "value", 0.0, rows - sum(held.values())))
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[at:at + 50_000], strict=True)], names=["f", "kind", "v", "n"])

    x = train.select(vector_to_array(features).alias("x"))
    found = x.mapInArrow(counted, "f long, kind string, v double, n long").groupBy("f", "kind", F.when(
        F.col("kind") == "value", F.col("v")).alias("v")).agg(F.sum("n").alias("n"), F.min("v").alias("least")).collect()
    number = 1 + max(r["f"] for r in found)
    after, values, many = [number] * number, [{} for _ in range(number)], set()
    for r in found:
        if r["kind"] == "next":
            after[r["f"]] = int(r["least"])
        elif r["kind"] == "many":
            many.add(r["f"])
        else:
            values[r["f"]][r["v"]] = r["n"]
    many |= {f for f, v in enumerate(values) if len(v) > 4 * limit}
    cuts = {}
    if many:
        shares = [i / max_bins for i in range(1, max_bins)]
        row = x.agg(*[F.percentile_approx(F.nanvl(F.col("x")[f], F.lit(None)), shares, 20 * max_bins).alias(f"f{f}")
                      for f in sorted(many)]).first()
        cuts = {f: np.unique(row[f"f{f}"] or []) for f in many}
    thresholds = []
    for f in range(number):
        v = sorted((v, n) for v, n in values[f].items() if v == v)
        nan = len(v) < len(values[f])
        t = cuts[f] if f in many else thresholds_of(np.array([a for a, _ in v]), np.array([n for _, n in v]), max_bins)
        # a missing value is larger than any other
        thresholds.append(np.append(t, v[-1][0]) if nan and v and f not in many else t)
    return Layout(thresholds, after)


def _binary(*columns, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.float64() if isinstance(c[0], float) else pa.int64())
         for c in columns], names=names)


BLOCK = "block long, codes binary, y binary"


def write_blocks(train: DataFrame, features: str, label: str, lay: Layout, name: str) -> DataFrame:
    """Rows as blocks of bin numbers and labels, written once to the shared folder."""
    from ridelens.sources.files import persist_table

    def blocks(batches):
        from pyspark import TaskContext

        part, i, codes, y, held = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            if b.num_rows:
                codes.append(lay.codes(_dense(b.column(0))))
                y.append(b.column(1).to_numpy(zero_copy_only=False).astype(float))
                if np.isnan(y[-1]).any():
                    raise ValueError("a label is null or NaN")
                held += b.num_rows
            if held >= BLOCK_ROWS:
                yield _binary([(part << 32) + i], [np.concatenate(codes).tobytes()], [np.concatenate(y).tobytes()],
                              names=["block", "codes", "y"])
                i, codes, y, held = i + 1, [], [], 0
        if held:
            yield _binary([(part << 32) + i], [np.concatenate(codes).tobytes()], [np.concatenate(y).tobytes()],
                          names=["block", "codes", "y"])

    x = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return persist_table(x.mapInArrow(blocks, BLOCK), name)


def _blocks(batches, lay: Layout):
    for b in batches:
        for i in range(b.num_rows):
            y = np.frombuffer(b.column("y")[i].as_py(), float)
            yield b.column("block")[i].as_py(), np.frombuffer(b.column("codes")[i].as_py(), lay.dtype).reshape(len(y), -1), y


class _Settings:
    def __init__(self, est, features: int):
        self.trees, self.depth, self.seed = est.getNumTrees(), est.getMaxDepth(), est.getSeed() % (1 << 63)
        self.least, self.min_gain = est.getMinInstancesPerNode(), est.getMinInfoGain()
        self.rate, self.bootstrap = est.getSubsamplingRate(), est.getBootstrap()
        self.take = features_taken(est.getFeatureSubsetStrategy(), self.trees, features)

    def weights(self, tree: int, block: int, n: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, tree, block])
        if self.bootstrap:
            return rng.poisson(self.rate, n).astype(np.uint8)
        return (rng.random(n) < self.rate).astype(np.uint8)

    def share(self) -> float:
        return 1.0 - float(np.exp(-self.rate)) if self.bootstrap else self.rate


def features_taken(strategy: str, trees: int, features: int) -> int:
    """Features that a node may split on (Spark's rules for regression)."""
    s = strategy.lower()
    if s == "all" or (s == "auto" and trees == 1):
        return features
    if s in ("auto", "onethird"):
        return max(1, int(np.ceil(features / 3.0)))
    if s == "sqrt":
        return max(1, int(np.ceil(np.sqrt(features))))
    if s == "log2":
        return max(1, int(np.ceil(np.log2(features))))
    number = float(s)
    return min(features, int(number)) if number >= 1 and "." not in s else max(1, int(np.ceil(number * features)))


def fit_forest(est, train: DataFrame, n: int) -> GrownTrees:
    """A random forest of ``est``'s settings on assembled rows (see the module)."""
    from ridelens.sources.files import drop_tables

    spark, tag = train.sparkSession, uuid.uuid4().hex[:12]
    lay = feature_layout(train, est.getFeaturesCol(), min(est.getMaxBins(), n, MAX_CODES))
    settings = _Settings(est, lay.features)
    blocks = write_blocks(train, est.getFeaturesCol(), est.getLabelCol(), lay, f"grow_{tag}_blocks")
    mean = train.agg(F.avg(est.getLabelCol())).first()[0] or 0.0
    trees = [Tree() for _ in range(settings.trees)]
    # leaves to grow on: (tree, node, rows, levels above)
    rows = n * settings.rate
    todo = [(t, 0, rows, 0) for t in range(settings.trees)]
    small, level = [], 0
    while todo:
        small += [x for x in todo if x[2] <= TASK_ROWS]
        todo = _split_large(blocks, lay, settings, mean, trees, [x for x in todo if x[2] > TASK_ROWS], level)
        level += 1
    sent = settings.share() / settings.rate * (len(lay.slots) * np.dtype(lay.dtype).itemsize + 9)
    wave, size, names = [], 0.0, []
    for i, x in enumerate(small):
        wave.append(x)
        size += x[2] * sent
        if size >= SENT_BYTES or i == len(small) - 1:
            names.append(f"grow_{tag}_trees{len(names)}")
            _grow_small(blocks, lay, settings, mean, trees, wave, names[-1])
            wave, size = [], 0.0
    drop_tables(spark, [f"grow_{tag}_blocks", *names])
    return GrownTrees(featuresCol=est.getFeaturesCol(), predictionCol=est.getPredictionCol())._of(
        lay, [(1.0 / len(trees), t) for t in trees], mean)


def _split_large(blocks, lay, settings, mean, trees, large, level) -> list:
    """One level of the nodes with many rows, from statistics of all tasks. Returns the children to go on with."""
    children, at = [], 0
    while at < len(large):
        part = large[at:at + max(1, PASS_BYTES // (lay.size * 16))]
        at += len(part)
        nodes: dict[int, list[int]] = {}
        for t, node, _, _ in part:
            nodes.setdefault(t, []).append(node)
        tops = {t: trees[t] for t in nodes}
        above = {(t, node): d for t, node, _, d in part}

        def counted(batches):
            held = {}
            for block, codes, y in _blocks(batches, lay):
                for t, ids in nodes.items():
                    w = settings.weights(t, block, len(y))
                    number = np.full(len(tops[t].split), -1, np.int64)
                    number[ids] = np.arange(len(ids))
                    number = number[tops[t].leaf_of(codes, lay)]
                    rows = np.flatnonzero((w > 0) & (number >= 0))
                    wr = w[rows].astype(float)
                    hn, hs = lay.statistics(codes[rows], number[rows], len(ids), wr, wr * (y[rows] - mean))
                    if t in held:
                        held[t][0][:], held[t][1][:] = held[t][0] + hn, held[t][1] + hs
                    else:
                        held[t] = (hn, hs)
            for t, (hn, hs) in held.items():
                yield _binary([t], [hn.tobytes()], [hs.tobytes()], names=["tree", "hn", "hs"])

        def merged(table):
            import pyarrow as pa

            t = table.column("tree")[0].as_py()
            hn, hs = (sum(np.frombuffer(v.as_py(), float) for v in table.column(c)).reshape(len(nodes[t]), -1) for c in ("hn", "hs"))
            # each row has one code in the first slot
            tn, ts = hn[:, :lay.base[1]].sum(axis=1), hs[:, :lay.base[1]].sum(axis=1)
            rng = np.random.default_rng([settings.seed, t, level, 1])
            split, ln, ls = best_splits(lay, hn, hs, tn, ts, some_features(rng, len(tn), lay.features, settings.take),
                                        settings.least, settings.min_gain)
            return pa.table({"tree": [t] * len(tn), "node": nodes[t], "split": split.astype(np.int64), "tn": tn, "ts": ts,
                             "ln": ln, "ls": ls})

        found = blocks.mapInArrow(counted, "tree long, hn binary, hs binary").groupBy("tree").applyInArrow(
            merged, "tree long, node long, split long, tn double, ts double, ln double, ls double").collect()
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            tree, depth = trees[r["tree"]], above[r["tree"], r["node"]] + 1
            tree.value[r["node"]] = r["ts"] / r["tn"] if r["tn"] else 0.0
            if r["split"] < 0 or depth > settings.depth:
                continue
            rn, rs = r["tn"] - r["ln"], r["ts"] - r["ls"]
            first = tree.add(np.array([r["node"]]), r["split"], [r["ls"] / r["ln"]], [rs / rn])
            children += [(r["tree"], first + i, c, depth) for i, c in enumerate((r["ln"], rn)) if depth < settings.depth]
    return children


def _grow_small(blocks, lay, settings, mean, trees, wave, name) -> None:
    """The rows of each node go to one task, which grows what is below it; the trees get it in the node's place."""
    from ridelens.sources.files import persist_table

    part, held, task = 0, 0.0, {}
    nodes: dict[int, list[int]] = {}
    for t, node, rows, depth in wave:
        if held and held + rows > TASK_ROWS / 4:
            part, held = part + 1, 0.0
        task[t, node], held = (part, depth), held + rows
        nodes.setdefault(t, []).append(node)
    tops = {t: trees[t] for t in nodes}

    def dealt(batches):
        for block, codes, y in _blocks(batches, lay):
            for t, ids in nodes.items():
                w = settings.weights(t, block, len(y))
                if len(tops[t].split) == 1:
                    groups = [(0, np.flatnonzero(w))]
                else:
                    leaf = np.where(w > 0, tops[t].leaf_of(codes, lay), -1)
                    rows = np.argsort(leaf, kind="stable")
                    ends = np.searchsorted(leaf[rows], [*ids, *(i + 1 for i in ids)])
                    groups = [(i, rows[ends[k]:ends[k + len(ids)]]) for k, i in enumerate(ids)]
                for node, rows in groups:
                    if len(rows):
                        yield _binary([task[t, node][0]], [t], [node], [block], [codes[rows].tobytes()], [y[rows].tobytes()],
                                      [w[rows].tobytes()], names=["part", "tree", "node", "block", "codes", "y", "w"])

    def grown(batches):
        held = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault((r["tree"], r["node"]), []).append((r["block"], r["codes"], r["y"], r["w"]))
        for (t, node), rows in held.items():
            rows.sort(key=lambda r: r[0])
            y = np.concatenate([np.frombuffer(r[2], float) for r in rows]) - mean
            w = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).astype(float)
            codes = np.concatenate([np.frombuffer(r[1], lay.dtype).reshape(-1, len(lay.slots)) for r in rows])
            rows.clear()
            rng = np.random.default_rng([settings.seed, t, node, 2])
            tree = grow(codes, y, w, lay, settings.depth - task[t, node][1], settings.take, settings.least, settings.min_gain, rng)
            yield _binary([t], [node], [tree.split.tobytes()], [tree.left.tobytes()], [tree.value.tobytes()],
                          names=["tree", "node", "split", "left", "value"])

    sent = blocks.mapInArrow(dealt, "part long, tree long, node long, block long, codes binary, y binary, w binary")
    out = sent.repartitionById(part + 1, F.col("part").cast("int")).mapInArrow(
        grown, "tree long, node long, split binary, left binary, value binary")
    for r in persist_table(out, name).toLocalIterator():
        trees[r["tree"]].graft(r["node"], Tree(np.frombuffer(r["split"], np.int32), np.frombuffer(r["left"], np.int32),
                                               np.frombuffer(r["value"], float)))


def fit_boosted(est, train: DataFrame, n: int) -> GrownTrees | None:
    """Boosted trees of ``est``'s settings in one task; None if their rows are too many for one."""
    from ridelens.sources.files import drop_tables

    if est.getSubsamplingRate() != 1.0 or est.getLossType() != "squared" or features_taken(
            est.getFeatureSubsetStrategy(), 1, 10) != 10:
        return None
    lay = feature_layout(train, est.getFeaturesCol(), min(est.getMaxBins(), n, MAX_CODES))
    if n * len(lay.slots) > BOOST_CODES:
        return None
    tag = uuid.uuid4().hex[:12]
    blocks = write_blocks(train, est.getFeaturesCol(), est.getLabelCol(), lay, f"boost_{tag}_blocks")
    mean = train.agg(F.avg(est.getLabelCol())).first()[0] or 0.0
    rounds, rate, depth = est.getMaxIter(), est.getStepSize(), est.getMaxDepth()
    least, min_gain = est.getMinInstancesPerNode(), est.getMinInfoGain()

    def boosted(batches):
        held = sorted(((b, c, y) for b, c, y in _blocks(batches, lay)), key=lambda r: r[0])
        codes, y = np.concatenate([r[1] for r in held]), np.concatenate([r[2] for r in held]) - mean
        held.clear()
        for i, (weight, tree) in enumerate(boost(codes, y, lay, rounds, rate, depth, least, min_gain)):
            yield _binary([i], [weight], [tree.split.tobytes()], [tree.left.tobytes()], [tree.value.tobytes()],
                          names=["tree", "weight", "split", "left", "value"])

    rows = blocks.coalesce(1).mapInArrow(boosted, "tree long, weight double, split binary, left binary, value binary").collect()
    drop_tables(train.sparkSession, [f"boost_{tag}_blocks"])
    return GrownTrees(featuresCol=est.getFeaturesCol(), predictionCol=est.getPredictionCol())._of(
        lay, [(r["weight"], Tree(np.frombuffer(r["split"], np.int32), np.frombuffer(r["left"], np.int32),
                                 np.frombuffer(r["value"], float))) for r in sorted(rows, key=lambda r: r["tree"])], mean)


# ---------------------------------------------------------------------------
# the model
# ---------------------------------------------------------------------------
class GrownTrees(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """``offset`` plus the weighted sum of trees. ``thresholds`` per feature; a tree is (weight, feature, bin, left child,
    value), bins up to the node's go left, a leaf is its own left child."""

    def __init__(self, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(featuresCol=featuresCol, predictionCol=predictionCol)
        self.thresholds, self.trees, self.offset, self._sent = [], [], 0.0, None

    def _of(self, lay: Layout, trees: list, offset: float) -> GrownTrees:
        self.thresholds, self.offset = lay.thresholds, float(offset)
        feature, bin_ = np.append(lay.feature, 0).astype(np.int32), np.append(lay.bin, MAX_CODES).astype(np.uint16)
        self.trees = [(w, feature[t.split], bin_[t.split], np.where(t.split >= 0, t.left, np.arange(len(t.split))).astype(np.int32),
                       t.value) for w, t in trees]
        return self

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._sent is None:
            self._sent = df.sparkSession.sparkContext.broadcast((self.thresholds, self.trees, self.offset))
        sent = self._sent

        def predicted(columns):
            import pyarrow as pa

            thresholds, trees, offset = sent.value
            for column in columns:
                yield pa.array(sum_of_trees(_dense(column), thresholds, trees, offset) if len(column) else [], pa.float64())

        from collections.abc import Iterator

        import pyarrow as pa

        predicted.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
        f = F.arrow_udf(predicted, "double")
        return df.withColumn(self.getPredictionCol(), f(vector_to_array(self.getFeaturesCol())))

    def write(self):
        return _GrownWriter(self)

    @classmethod
    def read(cls):
        return _GrownReader()


def sum_of_trees(x: np.ndarray, thresholds: list, trees: list, offset: float) -> np.ndarray:
    n, m = x.shape
    bins = np.empty((n, m), np.uint16)
    for f, t in enumerate(thresholds):
        bins[:, f] = np.searchsorted(t, x[:, f]) if len(t) else 0
    bins, first, out = bins.reshape(-1), np.arange(0, n * m, m), np.full(n, offset)
    for weight, feature, bin_, left, value in trees:
        node = np.zeros(n, np.int32)
        while True:
            here = left[node] + (bins[first + feature[node]] > bin_[node])
            if np.array_equal(here, node):
                break
            node = here
        out += weight * value[node]
    return out


class _GrownWriter(MLWriter):
    def __init__(self, model: GrownTrees):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={
            "offset": m.offset, "thresholds": json.dumps([t.tolist() for t in m.thresholds])})
        rows = [(i, float(w), *(bytearray(a.tobytes()) for a in arrays)) for i, (w, *arrays) in enumerate(m.trees)]
        spark.createDataFrame(rows, "tree long, weight double, feature binary, bin binary, left binary, value binary").write.parquet(
            f"{path.rstrip('/')}/trees")


class _GrownReader(MLReader):
    def load(self, path: str) -> GrownTrees:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        m = GrownTrees()
        DefaultParamsReader.getAndSetParams(m, meta)
        m._resetUid(meta["uid"])
        m.offset, m.thresholds = meta["offset"], [np.array(t, float) for t in json.loads(meta["thresholds"])]
        kinds = (np.int32, np.uint16, np.int32, float)
        m.trees = [(r["weight"], *(np.frombuffer(r[c], k) for c, k in zip(("feature", "bin", "left", "value"), kinds, strict=True)))
                   for r in sorted(spark.read.parquet(f"{path.rstrip('/')}/trees").toLocalIterator(), key=lambda r: r["tree"])]
        return m
