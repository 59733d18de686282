"""Gradient-boosted trees for several classes, grown on one table of binned values.

Values are cut into bins once. A round fits one tree per class to the softmax gradients; a level of all
those trees is one pass over the table that adds up gradients and curvatures per class, node, feature
and bin. The driver sees these sums, whose size depends on bins, nodes and classes, never on rows, and
finds the splits. Scores of the rows follow from the trees; every few rounds they are written next to
the bins, so a pass applies only the trees since then, and nothing else is kept with the rows. Rows that
have all bins and the class in common are told apart by no tree: they are one row with their weights'
sum, so the table has at most as many rows as there are filled cells of bins."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.session import dropped, materialised
from flowlab.tables import FAN_IN, ref, ship, spread, ticks, unpack

# Rounds after which the scores are written.
REFRESH = 10
# A split has to gain this much.
LEAST_GAIN = 1e-9
POLICIES = ("levels", "leaves", "symmetric")


@dataclass
class Growth:
    """How trees grow. ``levels``: every node of a level splits if it gains; ``leaves``: of these splits
    the best ones, up to a number of leaves; ``symmetric``: one split for all nodes of a level."""
    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    ridge: float = 1.0
    least_curvature: float = 1.0
    policy: str = "levels"
    leaves: int = 31


@dataclass
class Tree:
    """A binary tree as arrays; the children of node i are 2i + 1 and 2i + 2. Leaves have feature -1."""
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray
    value: np.ndarray = None

    @classmethod
    def empty(cls, depth):
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n))

    def node(self, bins, depth):
        """The node each row is in after at most ``depth`` steps."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.cut[at]), at)
        return at

    def filled(self, depth):
        """Features, cuts and values of a tree whose rows all go down ``depth`` steps: a leaf above sends
        them on to the left and hands its value down."""
        inner = 2 ** depth - 1
        leaf, value = self.feature[:inner] < 0, self.value.copy()
        for at in np.flatnonzero(leaf):
            value[2 * at + 1] = value[at]
        return np.where(leaf, 0, self.feature[:inner]), np.where(leaf, 255, self.cut[:inner]), value


@dataclass
class Boosted:
    """Fitted trees: ``rounds`` of one tree per class on top of the classes' log shares."""
    classes: list
    edges: list
    priors: np.ndarray
    depth: int
    rounds: list = field(default_factory=list)

    def binned(self, x):
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def add(self, scores, bins, first=0):
        cells, start = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                feature, cut, value = tree.filled(self.depth)
                at = np.zeros(len(bins), int)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (cells.take(start + feature.take(at)) > cut.take(at))
                scores[:, k] += value.take(at)
        return scores

    def scores(self, x):
        return self.add(np.tile(self.priors, (len(x), 1)), self.binned(x))


def probabilities(scores):
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def bin_edges(df, features, most, between=False):
    """Cut points per feature: between all values if there are at most ``most``, else quantiles. A cut between
    two values is the lower one, or with ``between`` their middle."""
    features = list(features)

    def values(batches):
        seen = [np.zeros(0)] * len(features)
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64)
            seen = [s if len(s) > most else np.unique(np.append(s, x[:, i])) for i, s in enumerate(seen)]
        for i, s in enumerate(seen):  # too many values are said by a null
            yield pd.DataFrame({"feature": i, "value": s if len(s) <= most else [None]}).astype({"value": "float64"})

    found = df.select(*ticks(features)).mapInPandas(values, "feature int, value double").distinct()
    few = {r["feature"]: sorted(r["v"]) for r in found.groupBy("feature").agg(
        F.collect_set("value").alias("v"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("over"))
        .where(f"over = 0 and size(v) <= {int(most)}").collect()}
    many = [f for i, f in enumerate(features) if i not in few]
    steps = [i / most for i in range(1, most)]
    cut = dict(zip(many, df.approxQuantile(many, steps, 0.1 / most))) if many else {}
    return [_cuts(np.array(few[i]), between) if i in few else np.unique(cut[f]) for i, f in enumerate(features)]


def _cuts(values, between):
    return (values[:-1] + values[1:]) / 2 if between else values[:-1]


def _rows(batch, n_features, n_classes):
    """Bins, class codes, weights and scores of a batch of the binned table."""
    def flat(name, kind, width):
        column = batch.column(name)
        _, offsets, data = column.buffers()
        first = np.frombuffer(offsets, np.int32)[column.offset]
        return np.frombuffer(data, kind, len(column) * width, first).reshape(len(column), width)

    return (flat("bins", np.uint8, n_features), np.asarray(batch.column("code")), np.asarray(batch.column("weight")),
            flat("scores", np.float64, n_classes))


def _binary(x):
    """The rows of a matrix as a column of bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _cells(bins, code, weight):
    """Bins, class code and summed weights of a batch, rows with the same bins and code as one."""
    rows = np.concatenate([bins, code.astype(np.int32).view(np.uint8).reshape(len(bins), 4)], axis=1)
    _, first, cell = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return pa.RecordBatch.from_arrays(
        [_binary(bins[first]), pa.array(code[first], pa.int32()), pa.array(np.bincount(cell, weight, len(first)), pa.float64())],
        names=["bins", "code", "weight"])


def _packed(bins, code, weight, scores):
    return pa.RecordBatch.from_arrays(
        [_binary(bins), pa.array(code, pa.int32()), pa.array(weight, pa.float64()), _binary(scores)],
        names=["bins", "code", "weight", "scores"])


CELLS = "bins binary, code int, weight double"
TABLE = CELLS + ", scores binary"


def _sums(table, model, known, partial, level, few):
    """Gradient and curvature sums per feature: arrays (class, node of the level, bin, 2). ``known``
    rounds are in the table's scores; ``few`` tells that one stage is enough to add up all tasks."""
    shipped = ship(table.sparkSession, (model, partial))
    p, k = len(model.edges), len(model.classes)
    sizes = [len(e) + 1 for e in model.edges]
    nodes, first = 2 ** level, 2 ** level - 1

    def rows_of(totals, lane):
        return pa.RecordBatch.from_arrays(
            [pa.array([lane] * p, pa.int32()), pa.array(range(p), pa.int32()), pa.array([t.tobytes() for t in totals], pa.binary())],
            names=["lane", "feature", "total"])

    def add_rows(batches):
        from pyspark import TaskContext

        model, partial = unpack(shipped)
        totals = [np.zeros((k, 2, nodes * s)) for s in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, code, weight, scores = _rows(batch, p, k)
            share = probabilities(model.add(scores.copy(), bins, known))
            gradient = share * weight[:, None]
            gradient[np.arange(len(code)), code] -= weight
            curvature = share * (1 - share) * weight[:, None]
            for c, tree in enumerate(partial):
                at = tree.node(bins, level) - first
                inside = at >= 0
                whole = inside.all()
                at, b = (at, bins) if whole else (at[inside], bins[inside])
                g, h = (x[:, c] if whole else x[inside, c] for x in (gradient, curvature))
                for i, s in enumerate(sizes):
                    cell = at * s + b[:, i]
                    totals[i][c, 0] += np.bincount(cell, g, nodes * s)
                    totals[i][c, 1] += np.bincount(cell, h, nodes * s)
        context = TaskContext.get()
        yield rows_of(totals, context.partitionId() % FAN_IN if context else 0)

    def add_parts(batches):
        totals, lane = {}, 0
        for batch in batches:
            for lane, f, raw in zip(*(batch.column(c).to_pylist() for c in ("lane", "feature", "total"))):
                part = np.frombuffer(raw)
                totals[f] = totals[f] + part if f in totals else part
        yield pa.RecordBatch.from_arrays(
            [pa.array([lane] * len(totals), pa.int32()), pa.array(list(totals), pa.int32()),
             pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["lane", "feature", "total"])

    parts = table.mapInArrow(add_rows, "lane int, feature int, total binary")
    if not few:
        parts = parts.repartition("lane", "feature").mapInArrow(add_parts, "lane int, feature int, total binary")
    out = [np.zeros((k, 2, nodes, s)) for s in sizes]
    for batch in parts.toArrow().to_batches():
        for f, raw in zip(batch.column("feature").to_pylist(), batch.column("total")):
            out[f] += np.frombuffer(raw.as_buffer()).reshape(out[f].shape)
    return out


def _splits(sums, growth):
    """Per feature the gain of every (class, node, cut), not allowed ones at minus infinity, and the
    sums of the left side."""
    for totals in sums:
        left = totals.cumsum(axis=3)
        whole = left[..., -1:]
        left = left[..., :-1]
        right = whole - left

        def score(x):
            return x[:, 0] ** 2 / (x[:, 1] + growth.ridge + 1e-300)

        gain = score(left) + score(right) - score(whole)
        fine = (left[:, 1] >= growth.least_curvature) & (right[:, 1] >= growth.least_curvature)
        yield np.where(fine, gain, -np.inf), left, whole


def _grow(trees, sums, level, growth):
    """Split the nodes of a level; returns whether any node was split."""
    nodes, first = 2 ** level, 2 ** level - 1
    found = list(_splits(sums, growth))
    grown = False
    for c, tree in enumerate(trees):
        best = [(-np.inf, -1, 0)] * nodes
        alive = [n for n in range(nodes) if level == 0 or tree.feature[(first + n - 1) // 2] >= 0]
        if growth.policy == "symmetric":
            common = (-np.inf, -1, 0)
            for f, (gain, _, _) in enumerate(found):
                total = np.where(np.isfinite(gain[c]), gain[c], 0.0)[alive].sum(axis=0) if alive else np.zeros(0)
                if len(total) and total.max() > common[0]:
                    common = (float(total.max()), f, int(total.argmax()))
            best = [common] * nodes
        else:
            for f, (gain, _, _) in enumerate(found):
                if gain.shape[2]:
                    cut = gain[c].argmax(axis=1)
                    for n in alive:
                        if gain[c, n, cut[n]] > best[n][0]:
                            best[n] = (float(gain[c, n, cut[n]]), f, int(cut[n]))
        for n in alive:
            gain, f, cut = best[n]
            at = first + n
            if level == 0:
                tree.gradient[0], tree.curvature[0] = found[0][2][c, :, 0, 0]
            if gain <= LEAST_GAIN:
                continue
            grown = True
            tree.feature[at], tree.cut[at], tree.gain[at] = f, cut, gain
            left, whole = found[f][1][c, :, n, cut], found[f][2][c, :, n, 0]
            for child, (g, h) in ((2 * at + 1, left), (2 * at + 2, whole - left)):
                tree.gradient[child], tree.curvature[child] = g, h
    return grown


def _best_first(tree, leaves):
    """Keep the splits that a tree gets which always splits its most gaining leaf."""
    kept, heap = set(), [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    while heap and len(kept) + 1 < leaves:
        _, at = heapq.heappop(heap)
        kept.add(at)
        for child in (2 * at + 1, 2 * at + 2):
            if child < len(tree.feature) and tree.feature[child] >= 0:
                heapq.heappush(heap, (-tree.gain[child], child))
    tree.feature[[n for n in np.flatnonzero(tree.feature >= 0) if n not in kept]] = -1


def fit(train, features, label, classes, growth, max_bins=64, weight=None):
    """Boosted trees for the rows of ``train`` whose label is one of ``classes``. Features have no missing
    values (see ``prepare``); ``weight`` names a column of row weights. Stops before ``rounds`` when no
    node of a round can be split. An empty table or a single class is refused."""
    if growth.policy not in POLICIES:
        raise ValueError(f"unknown growth policy: {growth.policy}")
    if not 2 <= max_bins <= 256:
        raise ValueError("bins are kept as bytes: 2 to 256")
    features, spark = list(features), train.sparkSession
    code = (F.array_position(F.array(*[F.lit(c) for c in classes]), ref(label)) - 1).cast("int")
    rows = train.select(*ticks(features), code.alias("_code"),
                        (ref(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")).where("_code >= 0")
    counts = {r["_code"]: r["w"] for r in rows.groupBy("_code").agg(F.sum("_weight").alias("w")).collect()}
    if len(counts) < 2:
        raise ValueError("boosting needs rows of two classes")
    mass = np.array([counts.get(c, 0.0) for c in range(len(classes))])
    model = Boosted(list(classes), bin_edges(rows, features, max_bins), np.log(np.maximum(mass, 1e-12) / mass.sum()), growth.depth)
    shipped = ship(spark, model)

    def cut(batches):
        model = unpack(shipped)
        for batch in batches:
            values = [np.asarray(batch.column(i).cast(pa.float64())) for i in range(len(features))]
            yield _cells(model.binned(np.stack(values, axis=1)), *(np.asarray(batch.column(c)) for c in ("_code", "_weight")))

    cells = spread(rows).mapInArrow(cut, CELLS).groupBy("bins", "code").agg(F.sum("weight").alias("weight"))
    table = materialised(cells.withColumn("scores", F.lit(bytearray(model.priors.tobytes()))), "bins")
    few, known = table.rdd.getNumPartitions() <= FAN_IN, 0
    for r in range(growth.rounds):
        if r - known >= REFRESH:
            table, known = _refreshed(table, model, known), r
        trees = [Tree.empty(growth.depth) for _ in classes]
        for level in range(growth.depth):
            if not _grow(trees, _sums(table, model, known, trees, level, few), level, growth):
                break
        if all(t.feature[0] < 0 for t in trees):
            break
        for tree in trees:
            if growth.policy == "leaves":
                _best_first(tree, growth.leaves)
            tree.value = -growth.step * tree.gradient / (tree.curvature + growth.ridge + 1e-300)
        model.rounds.append(trees)
    dropped(table)
    return model


def _refreshed(table, model, known):
    """The table with the scores of all rounds so far; the old one goes."""
    shipped = ship(table.sparkSession, model)
    p, k = len(model.edges), len(model.classes)

    def work(batches):
        model = unpack(shipped)
        for batch in batches:
            if batch.num_rows:
                bins, code, weight, scores = _rows(batch, p, k)
                yield _packed(bins, code, weight, model.add(scores.copy(), bins, known))

    fresh = materialised(table.mapInArrow(work, TABLE), "bins")
    dropped(table)
    return fresh


def tree_table(model, features, spark):
    """The splits of a model: round, class, node, feature, threshold (values up to it go left), gain, and
    the values of both children."""
    rows = [(r + 1, c, n, features[t.feature[n]], float(model.edges[t.feature[n]][t.cut[n]]), float(t.gain[n]),
             float(t.value[2 * n + 1]), float(t.value[2 * n + 2]))
            for r, trees in enumerate(model.rounds) for c, t in zip(model.classes, trees)
            for n in np.flatnonzero(t.feature >= 0).tolist()]
    return spark.createDataFrame(rows, "round int, class string, node int, feature string, threshold double, "
                                       "gain double, left_value double, right_value double")
