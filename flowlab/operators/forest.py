"""Random forests grown on one table of binned values.

Values are cut into bins once, and rows that have all bins, the class and the weight in common are one row
with their number: no tree can tell them apart. How often a tree draws such a row is a Poisson draw with that
number as its mean, the same as the sum of one draw per row; the draws of all trees follow from a hash of the
row and are written next to the bins once. A level of all trees is one pass that adds up draws per open node,
candidate feature, bin and class, in groups of nodes whose sums fit a task; the sums meet per node in a shuffle,
where the best split is found. The driver sees splits, never sums or rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.operators.boosting import bin_edges
from flowlab.session import dropped, materialised
from flowlab.tables import ref, ship, spread, ticks, unpack

# Numbers that a task holds for the open nodes of a pass, and nodes whose sums it sends in one batch.
HELD_VALUES, SENT_NODES = 6_000_000, 500
# A split has to gain this much.
LEAST_GAIN = 1e-12
# Forests of at most this many leaves are looked up by the bins of their leaves, larger ones are walked through.
BOXES = 16_384
# Pairs of row and tree followed at a time.
PAIRS = 1 << 20
# Combinations of ranges whose classes a task may keep.
KNOWN = 1 << 22


@dataclass
class Forest:
    """All trees as arrays over their nodes; node t is the root of tree t, leaves have feature -1, the children
    of a node are ``child`` (up to the cut) and ``child`` + 1, and ``totals`` are weights per class."""
    classes: list
    edges: list
    trees: int
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    gain: np.ndarray
    totals: np.ndarray

    @classmethod
    def roots(cls, classes, edges, trees):
        return cls(list(classes), edges, trees, np.full(trees, -1, np.int32), np.zeros(trees, np.int32), np.zeros(trees, np.int32),
                   np.zeros(trees), np.zeros((trees, len(classes))))

    def binned(self, x):
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def split(self, nodes, feature, cut, gain, left, right):
        """Split nodes; returns their children, the left ones first of each pair."""
        first = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.child[nodes], self.gain[nodes] = feature, cut, first, gain
        n = 2 * len(nodes)
        self.feature = np.append(self.feature, np.full(n, -1, np.int32))
        self.cut, self.child = (np.append(a, np.zeros(n, np.int32)) for a in (self.cut, self.child))
        self.gain = np.append(self.gain, np.zeros(n))
        self.totals = np.concatenate([self.totals, np.stack([left, right], axis=1).reshape(n, self.totals.shape[1])])
        return np.arange(n) + len(self.feature) - n

    def pruned(self):
        """The forest without splits whose two leaves predict the same class; children stand behind their parents."""
        guess = self.totals.argmax(axis=1)
        while True:
            inner = np.flatnonzero(self.feature >= 0)
            child = self.child[inner]
            idle = (self.feature[child] < 0) & (self.feature[child + 1] < 0) & (guess[child] == guess[child + 1])
            if not idle.any():
                break
            self.feature[inner[idle]] = -1
        return self._reached()

    def _reached(self):
        """The forest without nodes that no row gets to."""
        level, kept = np.arange(self.trees), [np.arange(self.trees)]
        while len(level):
            child = self.child[level[self.feature[level] >= 0]]
            level = np.stack([child, child + 1], axis=1).ravel()
            kept.append(level)
        kept = np.concatenate(kept)
        place = np.zeros(len(self.feature), np.int32)
        place[kept] = np.arange(len(kept))
        return Forest(self.classes, self.edges, self.trees, self.feature[kept], self.cut[kept], place[self.child[kept]],
                      self.gain[kept], self.totals[kept])

    def importances(self):
        """Per feature the mean share of the trees' gains, each weighted by the rows of its node."""
        tree, shares = np.zeros(len(self.feature), int), np.zeros((self.trees, len(self.edges)))
        tree[:self.trees] = np.arange(self.trees)
        for n in np.flatnonzero(self.feature >= 0):
            tree[self.child[n]] = tree[self.child[n] + 1] = tree[n]
            shares[tree[n], self.feature[n]] += self.gain[n] * self.totals[n].sum()
        total = shares.sum(axis=1, keepdims=True)
        mean = np.divide(shares, total, out=np.zeros_like(shares), where=total > 0).sum(axis=0)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def scores(self, x):
        """Sums over the trees of the class shares in the leaf of each row."""
        return self.scores_of(self.binned(x))

    def scores_of(self, bins):
        """The scores of rows that are binned already."""
        size = self.totals.sum(axis=1, keepdims=True)
        shares = np.divide(self.totals, size, out=np.zeros_like(self.totals), where=size > 0)
        leaves, low, high = self.boxes() if len(self.feature) <= 2 * BOXES else (np.zeros(0, int), None, None)
        if not len(leaves):
            step = max(1, PAIRS // self.trees)
            return np.concatenate([self._votes(bins[a: a + step], shares) for a in range(0, max(len(bins), 1), step)])
        # per feature and bin a bit for every leaf whose box holds the bin: a row's bits are those of its leaves
        value = np.arange(256)[:, None]
        masks = [np.packbits((low[:, f] <= value) & (value <= high[:, f]), axis=1) for f in range(bins.shape[1])]
        step, out = max(1, 4 * PAIRS // len(leaves)), np.empty((len(bins), len(self.classes)))
        for a in range(0, len(bins), step):
            some = bins[a: a + step]
            bits = masks[0].take(some[:, 0], axis=0)
            for f in range(1, bins.shape[1]):
                bits &= masks[f].take(some[:, f], axis=0)
            out[a: a + step] = np.unpackbits(bits, axis=1, count=len(leaves)).astype(np.float64) @ shares[leaves]
        return out

    def boxes(self):
        """All leaves, and per leaf and feature the lowest and the highest bin of the rows that get there."""
        p = len(self.edges)
        level, low, high, found = np.arange(self.trees), np.zeros((self.trees, p), int), np.full((self.trees, p), 255), []
        while len(level):
            inner = self.feature[level] >= 0
            found.append((level[~inner], low[~inner], high[~inner]))
            level, low, high = level[inner], low[inner].repeat(2, axis=0), high[inner].repeat(2, axis=0)
            feature, cut = self.feature[level], self.cut[level]
            left = 2 * np.arange(len(level))
            high[left, feature], low[left + 1, feature] = cut, cut + 1
            level = np.stack([self.child[level], self.child[level] + 1], axis=1).ravel()
        return tuple(np.concatenate(part) for part in zip(*found))

    def _votes(self, bins, shares):
        n, p, k = len(bins), bins.shape[1], len(self.classes)
        votes, flat = np.zeros((n, k)), np.ascontiguousarray(bins).ravel()
        row, at = np.repeat(np.arange(n), self.trees), np.tile(np.arange(self.trees), n)
        while len(row):
            feature = self.feature.take(at)
            inner = feature >= 0
            leaf, there = at[~inner], row[~inner]
            for c in range(k):
                votes[:, c] += np.bincount(there, shares[:, c].take(leaf), n)
            row, at, feature = row[inner], at[inner], feature[inner]
            at = self.child.take(at) + (flat.take(row * p + feature) > self.cut.take(at))
        return votes


class Guesses:
    """Class numbers that a forest gives for binned rows. Bins of a feature that no split parts are one range, and rows
    with the same ranges have the same scores: these are found once per combination that was met, and kept
    if at most ``KNOWN`` combinations are possible."""

    def __init__(self, model):
        cuts = [np.unique(model.cut[model.feature == f]) for f in range(len(model.edges))]
        self.model, self.sizes = model, [len(c) + 1 for c in cuts]
        self.lowest = [np.append(0, c + 1).astype(np.uint8) for c in cuts]
        self.strides = [math.prod(self.sizes[f + 1:]) for f in range(len(cuts))]
        self.ranges = [np.searchsorted(c, np.arange(256), "left") for c in cuts]
        possible = math.prod(self.sizes)
        self.known = np.full(possible, -1, np.int32) if possible <= KNOWN else None
        self.told_apart = possible < 1 << 62

    def of(self, bins):
        if not self.told_apart:
            return self.model.scores_of(bins).argmax(axis=1)
        code = np.zeros(len(bins), np.int64)
        for f, (own, stride) in enumerate(zip(self.ranges, self.strides)):
            code += (own * stride).take(bins[:, f])
        if self.known is None:
            some, place = np.unique(code, return_inverse=True)
            return self._scored(some)[place]
        guess = self.known.take(code)
        if (guess < 0).any():
            some = np.unique(code[guess < 0])
            self.known[some] = self._scored(some)
            guess = self.known.take(code)
        return guess

    def _scored(self, code):
        bins = [low[code // stride % size] for low, stride, size in zip(self.lowest, self.strides, self.sizes)]
        return self.model.scores_of(np.stack(bins, axis=1)).argmax(axis=1)


def poisson_draws(key, n, trees):
    """A draw per row and tree with the mean ``n`` of the row: the quantile of a uniform number that
    follows from the row's 64-bit key and the tree."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
    out = np.empty(u.shape, np.uint32)
    means, of = np.unique(n, return_inverse=True)
    for i, mean in enumerate(means.tolist()):
        reach = 10 * math.sqrt(mean) + 20
        low, high = max(0, int(mean - reach)), int(mean + reach)
        steps = np.append(0.0, np.cumsum(np.log(mean) - np.log(np.arange(low + 1, high + 1))))
        chance = np.exp(low * math.log(mean) - mean - math.lgamma(low + 1) + steps)
        mine = of == i
        out[mine] = np.minimum(low + np.searchsorted(chance.cumsum(), u[mine], "right"), high)
    return out


CELLS = "bins binary, code int, weight double, n bigint"
TABLE = "bins binary, code int, weight double, draws binary"


def _binary(rows):
    """Byte strings of one length, the rows of a matrix, as a column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column, width):
    """A column of byte strings of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _cells(bins, code, weight):
    """Rows of a batch with equal bins, code and weight as one with their number."""
    raw = np.concatenate([bins, code.astype(np.int32).view(np.uint8).reshape(-1, 4), weight.view(np.uint8).reshape(-1, 8)], axis=1)
    _, first, n = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel(), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([_binary(bins[first]), pa.array(code[first], pa.int32()), pa.array(weight[first]),
                                       pa.array(n, pa.int64())], names=["bins", "code", "weight", "n"])


def _table(rows, model, bootstrap, seed):
    """The binned table: bins, code, weight and the draws of every tree (one byte each where all are small)."""
    p, trees, shipped = len(model.edges), model.trees, ship(rows.sparkSession, model)

    def cut(batches):
        model = unpack(shipped)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(batch.column(i).cast(pa.float64())) for i in range(p)], axis=1)
                yield _cells(model.binned(x), *(np.array(batch.column(c)) for c in ("_code", "_weight")))

    def draw(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.asarray(batch.column("n"))
            drawn = poisson_draws(np.asarray(batch.column("key")), n, trees) if bootstrap else np.repeat(n[:, None], trees, 1).astype(np.uint32)
            small = drawn.max(axis=1) < 256
            for mine, kind in ((small, np.uint8), (~small, np.uint32)):
                at = pa.array(np.flatnonzero(mine))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("bins", "code", "weight")]
                                                 + [_binary(drawn[mine].astype(kind))], names=["bins", "code", "weight", "draws"])

    cells = spread(rows).mapInArrow(cut, CELLS).groupBy("bins", "code", "weight").agg(F.sum("n").alias("n"))
    keyed = cells.withColumn("key", F.xxhash64("bins", "code", "weight", F.lit(seed)))
    return materialised(keyed.mapInArrow(draw, TABLE), "forest")


def _draws(column, trees):
    raw = column.to_pylist()
    wide = np.array([len(r) > trees for r in raw])
    out = np.empty((len(raw), trees), np.uint32)
    for mine, kind in ((~wide, np.uint8), (wide, np.uint32)):
        out[mine] = np.frombuffer(b"".join(r for r, w in zip(raw, wide) if w == (kind is np.uint32)), kind).reshape(-1, trees)
    return out


def entropy(totals):
    """Entropy in bits of the class weights along the last axis."""
    share = totals / np.maximum(totals.sum(axis=-1, keepdims=True), 1e-300)
    return -(share * np.log2(np.maximum(share, 1e-300))).sum(axis=-1)


def best_splits(sums):
    """Per node the candidate, cut and gain of the best split, and the class weights on its left and its right.
    ``sums`` are weights per node, candidate feature, bin and class."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    size = [np.maximum(x.sum(axis=-1), 0.0) for x in (left, right, whole)]
    gain = entropy(whole) - (size[0] * entropy(left) + size[1] * entropy(np.maximum(right, 0.0))) / np.maximum(size[2], 1e-300)
    gain = np.where((size[0] > 0) & (size[1] > 1e-9 * size[2]), np.round(gain, 13), -1.0)
    best, rows = gain.reshape(len(sums), -1).argmax(axis=1), np.arange(len(sums))
    candidate, cut = np.divmod(best, sums.shape[2])
    return candidate, cut, gain[rows, candidate, cut], left[rows, candidate, cut], right[rows, candidate, cut]


FOUND = "slot int, candidate int, cut int, gain double, sides array<double>"


def _splits(table, model, nodes, candidates):
    """The best split of every open node by one pass over the table."""
    spark, p, k, trees = table.sparkSession, len(model.edges), len(model.classes), model.trees
    m, width = candidates.shape[1], max(len(e) + 1 for e in model.edges)
    # place of a node among the open ones; way: a node that leads to an open one
    slot = np.full(len(model.feature), -1, np.int32)
    slot[nodes] = np.arange(len(nodes))
    way = slot >= 0
    for n in np.flatnonzero(model.feature >= 0)[::-1]:
        way[n] = way[model.child[n]] | way[model.child[n] + 1]
    # offset of a feature's bins among a node's sums, below zero if it is no candidate
    offset = np.full((len(nodes), p), -1, np.int32)
    offset[np.arange(len(nodes))[:, None], candidates] = np.arange(m) * width
    shipped = ship(spark, (model.feature, model.cut, model.child, slot, way, offset))

    def add_rows(batches):
        feature, cut, child, slot, way, offset = unpack(shipped)
        totals = np.zeros(len(offset) * m * width * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, code = _bytes(batch.column("bins"), p), np.asarray(batch.column("code"))
            weight, draws = np.asarray(batch.column("weight")), _draws(batch.column("draws"), trees)
            flat = bins.ravel()
            row, at = np.nonzero(draws)
            mass = draws[row, at] * weight[row]
            while len(row):
                here = way.take(at)
                row, at, mass = row[here], at[here], mass[here]
                own = slot.take(at)
                found = own >= 0
                there, place, load = row[found], own[found].astype(np.int64), mass[found]
                for f in range(p):
                    o = offset[:, f].take(place)
                    asked = o >= 0
                    r = there[asked]
                    cell = ((place[asked] * (m * width) + o[asked] + bins[:, f].take(r)) * k + code.take(r))
                    if len(cell):
                        totals += np.bincount(cell, load[asked], len(totals))
                row, at, mass = row[~found], at[~found], mass[~found]
                at = child.take(at) + (flat.take(row * p + feature.take(at)) > cut.take(at))
        totals = totals.reshape(len(offset), -1)
        filled = np.flatnonzero(totals.any(axis=1))
        for a in range(0, len(filled), SENT_NODES):
            some = filled[a: a + SENT_NODES]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _binary(totals[some])], names=["slot", "total"])

    def add_parts(batches):
        totals = {}
        for batch in batches:
            for s, raw in zip(batch.column("slot").to_pylist(), batch.column("total")):
                part = np.frombuffer(raw.as_buffer())
                totals[s] = totals[s] + part if s in totals else part
        slots = sorted(totals)
        for a in range(0, len(slots), SENT_NODES):
            some = slots[a: a + SENT_NODES]
            candidate, cut, gain, left, right = best_splits(np.stack([totals[s] for s in some]).reshape(len(some), m, width, k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(candidate, pa.int32()), pa.array(cut, pa.int32()), pa.array(gain),
                 pa.array(np.concatenate([left, right], axis=1).tolist(), pa.list_(pa.float64()))],
                names=["slot", "candidate", "cut", "gain", "sides"])

    parts = table.mapInArrow(add_rows, "slot int, total binary").repartition(spark.sparkContext.defaultParallelism, "slot")
    found = parts.mapInArrow(add_parts, FOUND).toArrow().sort_by("slot")
    own = found.column("slot").to_numpy()
    sides = np.array(found.column("sides").to_pylist(), dtype=float).reshape(len(own), 2, k)
    candidate, cut, gain = (found.column(c).to_numpy() for c in ("candidate", "cut", "gain"))
    return own, candidates[own, candidate] if len(own) else candidate, cut, gain, sides[:, 0], sides[:, 1]


def fit(train, features, label, classes, trees=100, max_depth=30, max_bins=64, weight=None, seed=0):
    """A forest for the rows of ``train`` whose label is one of ``classes``: every tree on its own Poisson
    draws of the rows, every node on its own draw of as many features as the root of their number (a single
    tree takes all rows and all features). Splits lower the entropy most; a node with one class, without a gain,
    or at ``max_depth`` is a leaf. Features have no missing values (see ``prepare``)."""
    if not 2 <= max_bins <= 256:
        raise ValueError("bins are kept as bytes: 2 to 256")
    features = list(features)
    code = (F.array_position(F.array(*[F.lit(c) for c in classes]), ref(label)) - 1).cast("int")
    rows = train.select(*ticks(features), code.alias("_code"),
                        (ref(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")).where("_code >= 0")
    model = Forest.roots(classes, bin_edges(rows, features, max_bins, between=True), trees)
    table = _table(rows, model, trees > 1, seed)
    p, k = len(features), len(classes)
    m = math.ceil(math.sqrt(p)) if trees > 1 else p
    group = max(1, HELD_VALUES // (m * max(len(e) + 1 for e in model.edges) * k))
    nodes = np.arange(trees)
    for depth in range(max_depth):
        below = [np.zeros(0, int)]
        for a in range(0, len(nodes), group):
            some = nodes[a: a + group]
            rng = np.random.default_rng([seed, depth, a])
            candidates = np.sort(rng.random((len(some), p)).argsort(axis=1)[:, :m], axis=1)
            own, feature, cut, gain, left, right = _splits(table, model, some, candidates)
            model.totals[some[own]] = left + right
            fine = gain > LEAST_GAIN
            below.append(model.split(some[own[fine]], feature[fine], cut[fine], gain[fine], left[fine], right[fine]))
        nodes = np.concatenate(below)
        nodes = nodes[(model.totals[nodes] > 0).sum(axis=1) > 1]
        if not len(nodes):
            break
    dropped(table)
    if not model.totals[:trees].any():
        raise ValueError("no rows to fit on")
    return model.pruned()
