"""Tree ensembles grown level by level on Spark, with the split rules that MLlib has not got.

``LevelForest`` grows forests and extra trees by squared or absolute error, ``SecondOrderBoosting`` boosts trees by
gradients and hessians.  All trees of an ensemble (of a round, when boosting) grow together and each level is one pass:
tasks send every row down the trees grown so far and count it into cells (node, feature, bin), Spark adds the cells of all
tasks up, one group per node picks the split, and the driver collects one row per node.  Rows of equal features and label differ in their
draws alone: before the first level they become one row with the sums of their draws, so that a level reads no more rows than
there are different ones, however many were given.  If they are few, every task has all of them and grows whole trees.

For the absolute error a cell also has the label's bin, so a node's cells are a mergeable quantile sketch of the labels on
either side of each cut: medians and absolute deviations come from cumulated counts.  They are exact while a feature has at
most ``maxBins`` and the label at most ``labelBins`` different values; beyond that, cuts and medians lie on quantiles.

Sums are of integers (labels and gradients in 30-bit fixed point, rows by whole multiplicities), so the order of additions
and the partitioning change nothing.  Rows are drawn by a hash of ``keyCol``.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from inspect import signature

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, HasWeightCol
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.session import cut_lineage

FIXED_BITS = 30             # labels and gradients are rounded to this many bits of the largest
CELLS = 1 << 20             # cells a task holds before it passes them on
MERGED = 1 << 22            # numbers that a task holds of merged rows before it passes them on
HELD = 1 << 22              # numbers of merged rows up to which a tree is grown by one task that has them all
DEEPEST = 60                # levels that a node's number (children 2 i and 2 i + 1 of i) has room for
MARGIN_ROUNDS = 10          # boosting writes the margins of all rows once in so many rounds


# ---------------------------------------------------------------------------
# trees
# ---------------------------------------------------------------------------

@dataclass
class Tree:
    """A binary tree in arrays, the root first; a leaf has feature -1.  A row goes left if its value is at most the cut
    (NaN goes right)."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    weight: list = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: float, gain: float) -> tuple[int, int]:
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = left, right
        for child in (left, right):
            for name, start in (("feature", -1), ("cut", 0.0), ("left", child), ("right", child), ("value", 0.0),
                                ("gain", 0.0), ("weight", 0)):
                getattr(self, name).append(start)
        return left, right

    def depth(self) -> int:
        deep = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                deep[self.left[i]] = deep[self.right[i]] = deep[i] + 1
        return max(deep)

    def importances(self, n: int) -> np.ndarray:
        """Total gain by feature, as shares."""
        out = np.zeros(n)
        for f, g in zip(self.feature, self.gain):
            if f >= 0:
                out[f] += g
        return out / out.sum() if out.sum() else out


class Router:
    """Sends the rows of a matrix down trees."""

    def __init__(self, trees: list[Tree]):
        self.trees = [tuple(map(np.array, (t.feature, t.cut, t.left, t.right, t.value))) + (t.depth(),) for t in trees]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        feature, cut, left, right, _, depth = self.trees[tree]
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            f = feature[at]
            at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))
        return at

    def values(self, x: np.ndarray, tree: int) -> np.ndarray:
        return self.trees[tree][4][self.leaves(x, tree)]


# ---------------------------------------------------------------------------
# bins
# ---------------------------------------------------------------------------

def _few_values(df: DataFrame, columns: dict[str, Column], most: int) -> dict[str, list[float]]:
    """The sorted different values of each column that has at most ``most`` (null and NaN left out)."""
    sets = df.select(*[F.when(~F.isnan(c), c).alias(k) for k, c in columns.items()])
    counts = sets.agg(*[F.approx_count_distinct(k, 0.02).alias(k) for k in columns]).first().asDict()
    few = [k for k in columns if counts[k] <= 2 * most]         # the estimate errs by far less than half
    if not few:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("v")) for k in few]))
    rows = sets.select(pairs.alias("p")).select("p.*").where("v is not null").distinct() \
        .groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v"), F.count("*").alias("n")).where(F.col("n") <= most)
    return {r["k"]: list(r["v"]) for r in rows.collect()}       # at most ``most`` values for each column


def bin_edges(df: DataFrame, columns: dict[str, Column], bins: int, times: Column | None = None,
              held: dict[str, np.ndarray] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(cuts, representatives) per column: bin b holds values of at most cuts[b] and above cuts[b - 1].  With at most
    ``bins`` different values each has a bin of its own and cuts lie half-way between; otherwise cuts are quantiles, in which
    a row counts ``times``.  ``held`` are the columns' values, if at hand."""
    if held is None:
        few = _few_values(df, columns, bins)
    else:
        few = {k: v for k, v in ((k, np.unique(v[~np.isnan(v)])) for k, v in held.items()) if 0 < len(v) <= bins}
    out = {k: ((v[1:] + v[:-1]) / 2, v) for k, v in ((k, np.array(v, float)) for k, v in few.items())}
    many = [k for k in columns if k not in few]
    if many:
        frame = df.select(*[columns[k].alias(k) for k in many], *([] if times is None else [
            F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("_again")]))
        share = [i / bins for i in range(bins + 1)]
        for k, q in zip(many, frame.approxQuantile(many, share, 0.25 / bins)):
            points = np.unique(np.array(q, float))
            cuts = points[1:-1] if len(points) > 2 else points[:0]
            ends = np.concatenate((points[:1], cuts, points[-1:])) if len(points) else np.zeros(2)
            out[k] = (cuts, (ends[1:] + ends[:-1]) / 2 if len(ends) > 1 else ends)
    return out


# ---------------------------------------------------------------------------
# the cells of a level
# ---------------------------------------------------------------------------

@dataclass
class Level:
    """What the tasks of one pass need: the trees so far, the open nodes and the bins.

    ``slots[t]`` maps the nodes of tree t to the numbers of open nodes (-1: closed), ``used[t]`` are the features to count."""

    trees: list[Tree]
    slots: list[np.ndarray]
    used: list[list[int]]
    cuts: list[np.ndarray]
    label_cuts: np.ndarray | None        # with these, a cell also has the label's bin

    @property
    def width(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    @property
    def label_width(self) -> int:
        return 1 if self.label_cuts is None else len(self.label_cuts) + 1


def _reduce(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys and, for each, the sums of its rows (whole numbers, exact)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(s[order], first, axis=0) for s in sums))


def merge_rows(rows: DataFrame, draws: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (x array<double>, y double, w array of whole numbers) -> (x, y, n long, w array<long>): one row for equal x and y,
    how many they were and their sums of w.  Merged in the tasks that read them, then by a hash of x and y.  A task holds
    ``MERGED`` numbers and passes on what it has merged so far, so few rows may be left twice; they add up all the same.
    With ``draws``, w is one number a row, of which ``draws`` makes the row's weights."""
    kinds = "x array<double>, y double, n long, w array<long>"
    once = rows.select("x", "y", F.lit(1).cast("long").alias("n"), F.col("w").cast("array<long>").alias("w"))
    first = lambda batches: _merged(batches, draws)      # noqa: E731
    return once.mapInArrow(first, kinds).repartition("x", "y").mapInArrow(lambda batches: _merged(batches), kinds)


def _merged(batches: Iterator[pa.RecordBatch], draws: Callable[[np.ndarray], np.ndarray] | None = None
            ) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out(keys: np.ndarray, n: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = keys.view(np.float64).reshape(len(keys), -1)
        for at in range(0, len(keys), 10_000):
            v, m = values[at:at + 10_000], w[at:at + 10_000]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel()))
                     for c in (v[:, :-1], m)]
            yield pa.RecordBatch.from_arrays([lists[0], pa.array(v[:, -1].copy()), pa.array(n[at:at + 10_000]), lists[1]],
                                             ["x", "y", "n", "w"])

    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        values = np.column_stack((_matrix(batch.column(0), rows), batch.column(1).to_numpy(zero_copy_only=False))) + 0.0
        values[np.isnan(values)] = np.nan               # one zero and one NaN, so that equal rows have equal bytes
        keys = values.view(np.dtype((np.void, 8 * values.shape[1]))).ravel()
        w = _matrix(batch.column(3), rows, np.int64)
        held.append(_reduce(keys, batch.column(2).to_numpy(), w if draws is None else draws(w[:, 0])))
        size += len(held[-1][0]) * (values.shape[1] + held[-1][2].shape[1])
        if size > MERGED:
            held = [_reduce(*(np.concatenate(part) for part in zip(*held)))]
            size = len(held[0][0]) * (values.shape[1] + held[0][2].shape[1])
            if size > MERGED // 2:
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*_reduce(*(np.concatenate(part) for part in zip(*held))))


def _cells(level: Level) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (x array, y, a, b, w array) -> cells (key, a, b) with the sums of a w and b w for each tree's own w, or for the
    only one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, held, size = Router(level.trees), [], 0

        def merged() -> tuple:
            return _reduce(*(np.concatenate(part) for part in zip(*held)))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, w = _matrix(batch.column(0), n), _matrix(batch.column(4), n, np.int64)
            w = np.broadcast_to(w, (n, len(level.used))) if w.shape[1] == 1 else w
            y, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            bins = [np.searchsorted(c, x[:, f]) for f, c in enumerate(level.cuts)]
            lab = 0 if level.label_cuts is None else np.searchsorted(level.label_cuts, y)
            for t, used in enumerate(level.used):
                slot = level.slots[t][router.leaves(x, t)]
                some = np.flatnonzero((slot >= 0) & (w[:, t] > 0))
                if not len(some):
                    continue
                of = lab if level.label_cuts is None else lab[some]
                keys = [((slot[some] * len(bins) + f) * level.width + bins[f][some]) * level.label_width + of for f in used]
                held.append(_reduce(np.concatenate(keys), np.tile(a[some] * w[some, t], len(used)),
                                    np.tile(b[some] * w[some, t], len(used))))
                size += len(held[-1][0])
                if size > 2 * CELLS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > CELLS:
                        yield _cell_batch(*held[0])
                        held, size = [], 0
        if held:
            yield _cell_batch(*merged())

    return run


def _cell_batch(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])


def _matrix(column: pa.Array, rows: int, kind: type = float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


# ---------------------------------------------------------------------------
# split rules
# ---------------------------------------------------------------------------

class SquaredError:
    """Cells (a: sum of label x weight in fixed point, b: weight).  Cost: sum of squared deviations from the mean."""

    needs_labels = False

    def __init__(self, scale: float):
        self.scale = scale

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the cost falls by against a prediction of 0."""
        s = a / self.scale
        return np.divide(s * s, b, out=np.zeros(np.broadcast(s, b).shape), where=b > 0)

    def value(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a / self.scale, b, out=np.zeros(np.shape(b)), where=b > 0)


class SecondOrder:
    """Cells (a: gradients, b: hessians, in fixed point).  Leaf value -G / (H + l2), score G^2 / (H + l2)."""

    needs_labels = False

    def __init__(self, scale: float, l2: float):
        self.scale, self.l2 = scale, l2

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        g, h = a / self.scale, b / self.scale + self.l2
        return np.divide(g * g, h, out=np.zeros(np.broadcast(g, h).shape), where=h > 0)

    def value(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = b / self.scale + self.l2
        return np.divide(-a / self.scale, h, out=np.zeros(np.shape(h)), where=h > 0)


class AbsoluteError:
    """Cells (b: weight) by label bin.  Cost: sum of absolute deviations from the median."""

    needs_labels = True

    def __init__(self, labels: np.ndarray):
        self.labels = labels                            # the label that stands for each label bin, ascending

    def medians(self, b: np.ndarray) -> np.ndarray:
        """Median by row of a matrix (…, label bin) of weights; the mean of the two middle ones where there are two."""
        total = b.sum(-1, keepdims=True)
        run = np.cumsum(b, -1)
        low = np.argmax(2 * run >= total, -1)
        high = np.argmax(2 * run > total, -1)
        return np.where(total[..., 0] > 0, (self.labels[low] + self.labels[high]) / 2, 0.0)

    def score(self, b: np.ndarray) -> np.ndarray:
        m = self.medians(b)
        return -(b * np.abs(self.labels - m[..., None])).sum(-1)

    def value(self, b: np.ndarray) -> np.ndarray:
        return self.medians(b)


@dataclass
class SplitRule:
    """How one open node is split."""

    criterion: object
    cuts: list[np.ndarray]
    points: list[np.ndarray]             # a value that stands for each bin
    width: int
    label_width: int
    least_split: float = 2               # weight that a node needs to be split
    least_leaf: float = 1                # weight that each side needs (of ``b`` in the criterion's unit)
    least_gain: float = 0.0              # what the score must rise by
    features_per_node: int = 0           # 0: all
    random_cuts: bool = False            # one cut per feature, uniform between the node's least and greatest bin
    seed: int = 0

    @property
    def block(self) -> int:
        """The cells of a node."""
        return len(self.cuts) * self.width * self.label_width

    def best(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, names: list[str], allowed: list[list[int]]) -> dict:
        """The splits of several nodes, as arrays, from their cells (node i's keys from i x ``block`` on); ``names`` seed their
        draws, ``allowed`` are the features that each may use.  Feature -1: it stays a leaf."""
        nodes, n = len(names), len(self.cuts)
        sums = np.zeros((2, nodes * self.block), np.int64)
        sums[0, keys], sums[1, keys] = a, b
        a, b = sums.reshape(2, nodes, n, self.width, self.label_width)
        rule, every = self.criterion, np.arange(nodes)
        chosen, draws = np.zeros((nodes, n), bool), np.zeros((nodes, n))
        for i, (name, features) in enumerate(zip(names, allowed)):
            if self.random_cuts or self.features_per_node:
                draw = random.Random(f"{self.seed}|{name}")
                if self.features_per_node and self.features_per_node < len(features):
                    features = sorted(draw.sample(list(features), self.features_per_node))
                draws[i, features] = [draw.random() for _ in features]
            chosen[i, features] = True
        one = np.array([features[0] for features in allowed])      # every feature counts each row once
        all_labels, total_a = b[every, one].sum(1), a[every, one].sum((1, 2))
        total_b = all_labels.sum(-1)
        of = (all_labels,) if rule.needs_labels else (total_a, total_b)
        parent, value = rule.score(*of), rule.value(*of)
        found = {"feature": np.full(nodes, -1), "bin": np.zeros(nodes, int), "gain": np.zeros(nodes), "value": value,
                 "weight": total_b}
        for f in range(n):
            cuts = len(self.cuts[f])
            left_b = np.cumsum(b[:, f], 1)[:, :cuts]
            weight, total = left_b.sum(-1), total_b[:, None]
            ok = (weight > 0) & (weight < total) & (weight >= self.least_leaf) & (total - weight >= self.least_leaf) \
                & (chosen[:, f] & (total_b >= self.least_split))[:, None]
            if self.random_cuts:
                seen, most = b[:, f].sum(-1) > 0, len(self.points[f]) - 1
                low = self.points[f][np.minimum(np.argmax(seen, 1), most)]
                high = self.points[f][np.minimum(self.width - 1 - np.argmax(seen[:, ::-1], 1), most)]
                at = np.searchsorted(self.points[f], low + draws[:, f] * (high - low), side="right") - 1
                ok &= np.arange(cuts) == at[:, None]
            i, at = np.nonzero(ok)
            if not len(i):
                continue
            if rule.needs_labels:
                left = left_b[i, at]
                gain = rule.score(left) + rule.score(all_labels[i] - left) - parent[i]
            else:
                left = np.cumsum(a[:, f], 1)[:, :cuts].sum(-1)[i, at]
                gain = rule.score(left, weight[i, at]) + rule.score(total_a[i] - left, total_b[i] - weight[i, at]) - parent[i]
            gains = np.full(ok.shape, -np.inf)
            gains[i, at] = gain
            k = np.argmax(gains, 1)                     # ties: the first feature, the lowest cut
            better = gains[every, k] > found["gain"] + 1e-12 * np.abs(parent)
            for name, new in (("feature", f), ("bin", k), ("gain", gains[every, k])):
                found[name] = np.where(better, new, found[name])
        low = found["gain"] < self.least_gain
        found["feature"], found["gain"] = np.where(low, -1, found["feature"]), np.where(low, 0.0, found["gain"])
        return found


def _picker(rule: SplitRule, names: list[tuple[str, list[int]]], block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The cells of one open node -> its split."""
    def pick(cells: pd.DataFrame) -> pd.DataFrame:
        slot = int(cells["slot"].iloc[0])
        keys, a, b = (cells[c].to_numpy() for c in ("key", "a", "b"))
        name, allowed = names[slot]
        return pd.DataFrame({"slot": slot, **rule.best(keys - slot * block, a, b, [name], [allowed])})

    return pick


def grow(rows: DataFrame, trees: int, rule: SplitRule, depth: int, label_cuts: np.ndarray | None = None,
         allowed: list[list[int]] | None = None, name: str = "", held: "Held | None" = None) -> list[Tree]:
    """Grows ``trees`` trees together over the rows (x array<double>, y double, a long, b long, w array<long>): ``a`` and
    ``b`` are what the criterion sums, ``w`` holds per tree (or once for all) how often the row is in its sample.  One pass and two small
    shuffles a level, however many trees; the driver holds the trees.  ``allowed`` are the features that each tree may use;
    no rows give trees of one leaf.  ``held`` are the same rows, if they are few: then no pass is made over ``rows``."""
    if depth > DEEPEST:
        raise ValueError(f"trees are at most {DEEPEST} levels deep")
    if held:
        return _grow_held(rows.sparkSession, held, trees, rule, depth, label_cuts)
    forest = [Tree() for _ in range(trees)]
    allowed = allowed or [list(range(len(rule.cuts)))] * trees
    open_nodes = [(t, 0, 1) for t in range(trees)]      # tree, node, its number in the heap order
    for level in range(depth + 1):
        if not open_nodes:
            break
        slots = [np.full(len(t.feature), -1, np.int64) for t in forest]
        for s, (t, node, _) in enumerate(open_nodes):
            slots[t][node] = s
        last = level == depth
        # the deepest nodes only need their totals, for which one feature will do
        state = Level(forest, slots, [f[:1] if last else f for f in allowed], rule.cuts, label_cuts)
        block = len(rule.cuts) * state.width * state.label_width
        names = [(f"{name}|{t}|{heap}", allowed[t]) for t, _, heap in open_nodes]
        own = rule if not last else replace(rule, least_split=math.inf)
        cells = rows.mapInArrow(_cells(state), "key long, a long, b long") \
            .groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")) \
            .withColumn("slot", F.floor(F.col("key") / F.lit(block)).cast("long"))
        picked = cells.groupBy("slot").applyInPandas(
            _picker(own, names, block), "slot long, feature int, bin int, gain double, value double, weight long").collect()
        following = []
        for r in sorted(picked, key=lambda r: r["slot"]):
            t, node, heap = open_nodes[r["slot"]]
            tree = forest[t]
            tree.value[node], tree.weight[node] = r["value"], r["weight"]
            if r["feature"] >= 0:
                left, right = tree.split(node, r["feature"], float(rule.cuts[r["feature"]][r["bin"]]), r["gain"])
                following += [(t, left, 2 * heap), (t, right, 2 * heap + 1)]
        open_nodes = following
    return forest


@dataclass
class Held:
    """Merged rows in memory: features, labels, how many rows each was, their weights (a column per tree, or one), and what the
    criterion sums."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    w: np.ndarray
    a: np.ndarray | None = None

    @classmethod
    def of(cls, rows: DataFrame) -> "Held":
        table = rows.select("x", "y", "n", "w").toArrow().combine_chunks()
        x, y, n, w = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        size = table.num_rows
        held = cls(_matrix(x, size), y.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), _matrix(w, size, np.int64))
        order = np.lexsort((held.y, *held.x.T))         # wherever rows were merged, trees get them in one order
        return cls(held.x[order], held.y[order], held.n[order], held.w[order])


def _grow_held(spark: SparkSession, held: Held, trees: int, rule: SplitRule, depth: int, label_cuts: np.ndarray | None) -> list[Tree]:
    """The trees that ``grow`` gives, each grown to its end by one task that has all rows: one job however deep they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tree = _held_tree(held, t, rule, depth, label_cuts)
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([json.dumps(tree.__dict__)])], ["t", "tree"])

    found = spark.range(0, trees, 1, trees).mapInArrow(run, "t long, tree string").collect()
    return [Tree(**json.loads(r["tree"])) for r in sorted(found, key=lambda r: r["t"])]


def _held_tree(held: Held, t: int, rule: SplitRule, depth: int, label_cuts: np.ndarray | None) -> Tree:
    tree, n = Tree(), len(rule.cuts)
    w = held.w[:, t if held.w.shape[1] > 1 else 0]
    some = np.flatnonzero(w > 0)
    w, aw = w[some], (held.a * w)[some]
    bins = np.column_stack([np.searchsorted(c, held.x[some, f]) for f, c in enumerate(rule.cuts)])
    cell = (np.arange(n) * rule.width + bins) * rule.label_width
    if label_cuts is not None:
        cell += np.searchsorted(label_cuts, held.y[some])[:, None]
    nodes, at = [(0, 1)] if len(some) else [], np.zeros(len(some), np.int64)   # open nodes (node, heap number), each row's place among them
    for level in range(depth + 1):
        own = rule if level < depth else replace(rule, least_split=math.inf)
        order = np.argsort(at, kind="stable")           # rows by node, so that few nodes' cells are held at once
        cell, bins, w, aw, at = cell[order], bins[order], w[order], aw[order], at[order]
        following, place = [], np.full((len(nodes), 2), -1)
        features, cuts = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        step = max(1, CELLS // rule.block)
        for first in range(0, len(nodes), step):
            part = nodes[first:first + step]
            lo, hi = np.searchsorted(at, (first, first + len(part)))
            keys = ((at[lo:hi] - first) * rule.block)[:, None] + cell[lo:hi]
            got = own.best(*_reduce(keys.ravel(), np.repeat(aw[lo:hi], n), np.repeat(w[lo:hi], n)),
                           [f"|{t}|{heap}" for _, heap in part], [list(range(n))] * len(part))
            features[first:first + len(part)], cuts[first:first + len(part)] = got["feature"], got["bin"]
            for i, (node, heap) in enumerate(part):
                tree.value[node], tree.weight[node] = float(got["value"][i]), int(got["weight"][i])
                f = int(got["feature"][i])
                if f >= 0:
                    left, right = tree.split(node, f, float(rule.cuts[f][got["bin"][i]]), float(got["gain"][i]))
                    place[first + i] = len(following), len(following) + 1
                    following += [(left, 2 * heap), (right, 2 * heap + 1)]
        stay = np.flatnonzero(features[at] >= 0)
        f, was = features[at[stay]], at[stay]
        at = place[was, (bins[stay, f] > cuts[was]).astype(int)]
        cell, bins, w, aw, nodes = cell[stay], bins[stay], w[stay], aw[stay], following
        if not nodes:
            break
    return tree


# ---------------------------------------------------------------------------
# draws
# ---------------------------------------------------------------------------

def uniform(key: Column, *salt) -> Column:
    """A number in (0, 1) from a hash of the key and the salt."""
    h = F.xxhash64(key, *[s if isinstance(s, Column) else F.lit(s) for s in salt])
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def poisson_steps(mean: float = 1.0, most: int = 16) -> list[float]:
    """The chances of at most 0, 1, ... draws."""
    chance = [math.exp(-mean)]
    for i in range(1, most):
        chance.append(chance[-1] * mean / i)
    return np.cumsum(chance).tolist()


def drawn(u: Column, steps: list[float]) -> Column:
    """How often a row is drawn, by the quantile ``u`` of the chances ``steps``."""
    out = F.when(u <= steps[0], F.lit(0))
    for n, c in enumerate(steps[1:], 1):
        out = out.when(u <= c, F.lit(n))
    return out.otherwise(F.lit(len(steps))).cast("short")


def bootstrap(key: Column, trees: int, seed: int) -> Column:
    """Per tree, how often a row is in a sample drawn with replacement: one array column, by a hash of the row's key."""
    steps = poisson_steps()
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(uniform(key, seed, t), steps))


def bootstrap_draws(trees: int) -> Callable[[np.ndarray], np.ndarray]:
    """The counts of ``bootstrap``, one column per tree, from the hashes of key and seed."""
    steps = np.array(poisson_steps())

    def draws(h: np.ndarray) -> np.ndarray:
        out = np.empty((len(h), trees), np.int64)
        for t in range(trees):
            u = (_hash_int(t, h) & np.uint64((1 << 52) - 1)).astype(float) + 0.5
            out[:, t] = np.searchsorted(steps, u / float(1 << 52))
        return out

    return draws


def _hash_int(value: int, h: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of an int, behind the columns whose hash is ``h``."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (h.astype(np.int64).view(np.uint64) + p5 + np.uint64(4)) ^ (np.full(1, value, np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def poisson(u: Column, mean: Column, most: int = 200) -> Column:
    """The Poisson quantile of ``u`` for a mean of each row's own; more than ``most`` draws count as ``most``."""
    @F.pandas_udf("int")
    def quantile(u: pd.Series, mean: pd.Series) -> pd.Series:
        u, mean = u.to_numpy(float), mean.to_numpy(float)
        n, p = np.zeros(len(u), np.int32), np.exp(-mean)
        c = p.copy()
        left = np.flatnonzero(c < u)
        for i in range(1, most + 1):                    # a step for the rows that have not got there
            if not len(left):
                break
            n[left] += 1
            p[left] = p[left] * mean[left] / i
            c[left] += p[left]
            left = left[c[left] < u[left]]
        return pd.Series(n)

    return quantile(u, mean)


# ---------------------------------------------------------------------------
# estimators
# ---------------------------------------------------------------------------

def features_array(name: str) -> Column:
    """A vector column as an array; null stays null."""
    return F.when(F.col(name).isNotNull(), vector_to_array(F.col(name)))


def _param(name: str, doc: str, kind=None) -> Param:
    return Param(Params._dummy(), name, doc, kind) if kind else Param(Params._dummy(), name, doc)


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, HasWeightCol):
    maxDepth = _param("maxDepth", "levels below the root", TypeConverters.toInt)
    maxBins = _param("maxBins", "bins of a feature", TypeConverters.toInt)
    keyCol = _param("keyCol", "column by whose hash rows are drawn; unset: the features and the label", TypeConverters.toString)

    def _key(self) -> Column:
        """What rows are drawn by.  Without a key column equal rows are drawn alike."""
        if self.isSet(self.keyCol):
            return F.col(self.getOrDefault(self.keyCol)).cast("string")
        return F.xxhash64(self._x(), F.col(self.getLabelCol()).cast("double")).cast("string")

    def _x(self) -> Column:
        return features_array(self.getFeaturesCol())

    def _given(self, df: DataFrame) -> DataFrame:
        """(x, y, key, given weight) of the rows with a label."""
        weight = F.col(self.getWeightCol()) if self.isSet(self.weightCol) else F.lit(1)
        return df.select(self._x().alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), self._key().alias("key"),
                         weight.cast("int").alias("given")).where("x is not null and y is not null and not isnan(y) and given > 0")

    def _edges(self, rows: DataFrame, n: int, held: Held | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        edges = bin_edges(rows, {f"x{f}": F.col("x")[f] for f in range(n)}, self.getOrDefault(self.maxBins), F.col("n"),
                          held and {f"x{f}": held.x[:, f] for f in range(n)})
        return [edges[f"x{f}"][0] for f in range(n)], [edges[f"x{f}"][1] for f in range(n)]

    def _fill(self, given: dict) -> None:
        """The constructor's defaults as the params' defaults, and what the caller gave."""
        defaults = {k: p.default for k, p in signature(type(self).__init__).parameters.items() if p.default is not p.empty}
        self._setDefault(**{k: v for k, v in defaults.items() if v is not None})
        self._set(**{k: v for k, v in given.items() if v is not None})


def fixed_scale(largest: float) -> float:
    """The power of two that brings ``largest`` to about ``FIXED_BITS`` bits; whole numbers stay whole."""
    return 2.0 ** (FIXED_BITS - max(math.frexp(largest)[1], 0)) if largest else 1.0


class LevelForest(Estimator, _TreeParams):
    """A regression forest.

    ``criterion`` is ``squared`` or ``absolute`` (leaves are means or medians); ``splitter`` is ``best``, or ``random`` for
    extra trees: one cut drawn for each feature of each node, uniform between the node's least and greatest value.
    ``bootstrap`` draws rows with replacement for each tree (Poisson with mean 1); ``maxFeatures`` is the share of features
    that a node may split on; ``minSplit`` and ``minLeaf`` are rows that a node and each side of a split need;
    ``minDecrease`` is the fall of the cost, over all rows of the tree, that a split must bring.

    Rows without a label or features, or of weight 0, are left out; ``weightCol`` holds whole numbers, how often a row counts.  A NaN
    feature goes right at every cut.  No rows give trees that predict 0."""

    numTrees = _param("numTrees", "trees", TypeConverters.toInt)
    criterion = _param("criterion", "squared or absolute", TypeConverters.toString)
    splitter = _param("splitter", "best or random", TypeConverters.toString)
    bootstrap = _param("bootstrap", "whether each tree draws its rows", TypeConverters.toBoolean)
    maxFeatures = _param("maxFeatures", "share of the features that a node may split on", TypeConverters.toFloat)
    minSplit = _param("minSplit", "rows a node needs to be split", TypeConverters.toFloat)
    minLeaf = _param("minLeaf", "rows each side of a split needs", TypeConverters.toFloat)
    minDecrease = _param("minDecrease", "least fall of the mean cost by a split", TypeConverters.toFloat)
    labelBins = _param("labelBins", "bins of the label for the absolute error", TypeConverters.toInt)
    weightsArrayCol = _param("weightsArrayCol", "array column of whole multiplicities, one per tree, instead of drawing",
                             TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None, keyCol=None,
                 seed=1, numTrees=100, maxDepth=10, maxBins=64, criterion="squared", splitter="best", bootstrap=True,
                 maxFeatures=1.0, minSplit=2.0, minLeaf=1.0, minDecrease=0.0, labelBins=256, weightsArrayCol=None):
        super().__init__()
        self._fill(self._input_kwargs)

    def sample(self, df: DataFrame) -> Column:
        """The multiplicities of a row, one per tree."""
        if self.isSet(self.weightsArrayCol):
            return F.col(self.getOrDefault(self.weightsArrayCol))
        trees = self.getOrDefault(self.numTrees)
        if self.getOrDefault(self.bootstrap):
            return bootstrap(self._key(), trees, self.getSeed())
        return F.array_repeat(F.lit(1), trees)

    def _fit(self, dataset: DataFrame) -> "TreesModel":
        get = self.getOrDefault
        weight = F.col(self.getWeightCol()) if self.isSet(self.weightCol) else F.lit(1)
        # where all trees see the same rows one weight serves them all, and plain draws are made where rows are merged
        given, boot, trees = self.isSet(self.weightsArrayCol), get(self.bootstrap), get(self.numTrees)
        draws = bootstrap_draws(trees) if boot and not given and not self.isSet(self.weightCol) else None
        if draws:
            w = F.array(F.xxhash64(self._key(), F.lit(self.getSeed())))
        else:
            w = F.transform(self.sample(dataset) if boot or given else F.array(F.lit(1)),
                            lambda m: F.coalesce((m * weight).cast("long"), F.lit(0).cast("long")))
        rows = dataset.select(self._x().alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), w.alias("w")) \
            .where("x is not null and y is not null and not isnan(y)")
        rows = cut_lineage(merge_rows(rows, draws))     # read once a level: the draws are made once
        count, n, width, total, largest = rows.agg(
            F.count("*"), F.max(F.size("x")), F.max(F.size("w")),
            F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda s, v: s + v)), F.max(F.abs("y"))).first()
        if not count:
            return self._copyValues(TreesModel([Tree()], 0, 1.0, 0.0))
        absolute, held = get(self.criterion) == "absolute", None
        if count * (n + 2 + width) <= HELD:
            held = Held.of(rows)
        if get(self.criterion) not in ("absolute", "squared") or get(self.splitter) not in ("best", "random"):
            raise ValueError("criterion is squared or absolute, splitter best or random")
        cuts, points = self._edges(rows, n, held)
        total *= 1 if boot or given else trees
        if absolute:
            label_cuts, labels = bin_edges(rows, {"y": F.col("y")}, get(self.labelBins), F.col("n"), held and {"y": held.y})["y"]
            criterion, scale = AbsoluteError(labels), 0.0
        else:
            scale = fixed_scale(largest)
            label_cuts, criterion = None, SquaredError(scale)
        share = get(self.maxFeatures)
        rule = SplitRule(criterion, cuts, points, max(map(len, cuts)) + 1, 1 if label_cuts is None else len(label_cuts) + 1,
                         get(self.minSplit), get(self.minLeaf), get(self.minDecrease) * total / trees,
                         0 if share >= 1 else max(1, int(share * n)), get(self.splitter) == "random", self.getSeed())
        cells = rows.select("x", "y", F.rint(F.col("y") * scale).cast("long").alias("a"), F.lit(1).cast("long").alias("b"), "w")
        a = held and np.rint(held.y * scale).astype(np.int64)
        forest = grow(cells, trees, rule, get(self.maxDepth), label_cuts, None, "", held and replace(held, a=a))
        return self._copyValues(TreesModel(forest, n, 1.0 / len(forest), 0.0))


class SecondOrderBoosting(Estimator, _TreeParams):
    """Boosting by gradients and hessians of the squared error: a leaf holds -G / (H + ``l2``), a split gains
    (GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)) / 2 - ``gamma``, each side needs a hessian sum of
    ``minChildWeight`` (one a row), and a tree sees a drawn share of rows (``subsample``) and of features
    (``columnSample``).  A prediction is ``baseScore`` plus ``stepSize`` times the leaves.

    Rows without a label are left out; no rows give ``baseScore``.  The margins of all rows are written once in
    ``MARGIN_ROUNDS`` rounds; between, the trees since then are added on the fly."""

    numRounds = _param("numRounds", "trees", TypeConverters.toInt)
    stepSize = _param("stepSize", "factor of each tree", TypeConverters.toFloat)
    l2 = _param("l2", "added to the hessian sum", TypeConverters.toFloat)
    gamma = _param("gamma", "least gain of a split", TypeConverters.toFloat)
    minChildWeight = _param("minChildWeight", "least hessian sum of each side", TypeConverters.toFloat)
    subsample = _param("subsample", "share of rows per tree", TypeConverters.toFloat)
    columnSample = _param("columnSample", "share of features per tree", TypeConverters.toFloat)
    baseScore = _param("baseScore", "prediction before the first tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None, keyCol=None,
                 seed=1, numRounds=100, stepSize=0.1, maxDepth=6, maxBins=64, l2=1.0, gamma=0.0, minChildWeight=1.0,
                 subsample=1.0, columnSample=1.0, baseScore=0.5):
        super().__init__()
        self._fill(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TreesModel":
        get = self.getOrDefault
        base, eta, share = get(self.baseScore), get(self.stepSize), get(self.subsample)
        inside = F.array(F.lit(True)) if share >= 1 else F.transform(
            F.sequence(F.lit(0), F.lit(get(self.numRounds) - 1)), lambda r: uniform(F.col("key"), self.getSeed(), r) < share)
        # rows of equal features have equal margins: they stay merged, with how many of them each round draws
        rows = cut_lineage(merge_rows(self._given(dataset).select(
            "x", "y", F.transform(inside, lambda i: i.cast("long") * F.col("given")).alias("w"))))
        first = rows.select(F.size("x")).first()
        if first is None:
            return self._copyValues(TreesModel([Tree()], 0, eta, base))
        n, rows = first[0], rows.withColumn("margin", F.lit(base))
        cuts, points = self._edges(rows, n)
        largest = rows.agg(F.max(F.abs(F.col("y") - base))).first()[0]
        scale = fixed_scale(max(2 * largest, 1.0))       # a margin may overshoot by as much as it was off
        width = max(map(len, cuts)) + 1
        forest: list[Tree] = []
        fresh: list[Tree] = []
        for r in range(get(self.numRounds)):
            draw = random.Random(f"{self.getSeed()}|columns|{r}")
            allowed = sorted(draw.sample(range(n), max(1, int(get(self.columnSample) * n))))
            rule = SplitRule(SecondOrder(scale, get(self.l2)), cuts, points, width, 1, 0, get(self.minChildWeight) * scale,
                             2 * get(self.gamma), seed=self.getSeed())
            margin = F.col("margin") + F.lit(eta) * tree_sum(fresh)(F.col("x")) if fresh else F.col("margin")
            state = rows.select(
                "x", "y", F.rint((margin - F.col("y")) * scale).cast("long").alias("a"),
                F.lit(int(scale)).cast("long").alias("b"), F.array(F.col("w")[0 if share >= 1 else r]).alias("w"))
            tree, = grow(state, 1, rule, get(self.maxDepth), None, [allowed], str(r))
            forest.append(tree)
            fresh.append(tree)
            if len(fresh) == MARGIN_ROUNDS:
                rows = cut_lineage(rows.withColumn("margin", F.col("margin") + F.lit(eta) * tree_sum(fresh)(F.col("x"))))
                fresh = []
        return self._copyValues(TreesModel(forest, n, eta, base))


def tree_sum(trees: list[Tree]) -> Callable[[Column], Column]:
    """A column function of the features array: the sum of the trees' values."""
    router = Router(trees)

    # of one series: Spark runs the sums of several models in one Python worker, which iterators would not allow
    @F.pandas_udf("double")
    def total(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), float).reshape(len(x), -1)
        return pd.Series(sum((router.values(m, t) for t in range(len(trees))), np.zeros(len(x))))

    return total


class TreesModel(Model, HasFeaturesCol, HasPredictionCol):
    """A fitted ensemble: ``base`` + ``factor`` x the sum of the trees' leaves.  A null features vector gives a null."""

    def __init__(self, trees: list[Tree] | None = None, n_features: int = 0, factor: float = 1.0, base: float = 0.0):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self.trees, self.n_features, self.factor, self.base = trees or [Tree()], n_features, factor, base

    def setPredictionCol(self, name: str) -> "TreesModel":
        return self._set(predictionCol=name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = features_array(self.getFeaturesCol())
        out = F.lit(self.base) + F.lit(self.factor) * tree_sum(self.trees)(F.coalesce(x, F.array(
            *[F.lit(float("nan"))] * max(self.n_features, 1))))
        return dataset.withColumn(self.getPredictionCol(), F.when(x.isNotNull(), out))

    def out_of_bag(self, dataset: DataFrame, weights: Column, out: str = "oob_pred") -> DataFrame:
        """Adds the mean value of the trees whose sample left the row out (``weights``, one per tree, is 0 there); null
        where every tree drew it.  One pass for all trees."""
        trees = self.trees

        @F.pandas_udf("double")
        def mean(x: pd.Series, w: pd.Series) -> pd.Series:
            router = Router(trees)
            m, left = np.array(x.tolist(), float).reshape(len(x), -1), np.array(w.tolist()).reshape(len(x), -1) == 0
            total = sum(np.where(left[:, t], router.values(m, t), 0.0) for t in range(len(trees)))
            n = left.sum(1)
            return pd.Series(np.divide(total, n, out=np.full(len(x), np.nan), where=n > 0))

        found = mean(features_array(self.getFeaturesCol()), weights)
        return dataset.withColumn(out, F.when(~F.isnan(found), found))

    @property
    def featureImportances(self) -> np.ndarray:
        """Mean over the trees of each feature's share of the tree's gain."""
        return np.mean([t.importances(self.n_features) for t in self.trees], 0)

    def to_rows(self) -> list[str]:
        """The model as JSON lines, one per tree."""
        head = {"n_features": self.n_features, "factor": self.factor, "base": self.base,
                "features": self.getFeaturesCol(), "prediction": self.getPredictionCol()}
        return [json.dumps({**head, "at": i, **t.__dict__}) for i, t in enumerate(self.trees)]

    @classmethod
    def from_rows(cls, lines: list[str]) -> "TreesModel":
        rows = sorted(map(json.loads, lines), key=lambda r: r["at"])
        head = rows[0]
        names = Tree().__dict__
        model = cls([Tree(**{k: r[k] for k in names}) for r in rows], head["n_features"], head["factor"], head["base"])
        return model._set(featuresCol=head["features"], predictionCol=head["prediction"])
