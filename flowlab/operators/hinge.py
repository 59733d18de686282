"""Linear hinge classifiers, one against the rest, for all classes at once.

The squared hinge is solved by Newton steps: a pass over the rows gives loss, gradient and curvature of
every class from one product of the rows with all weights. The plain hinge is fitted by averaged
stochastic gradient descent: a task goes through its rows in small batches with a falling step, and the
tasks' weights are averaged after every pass. Rows stay where they are; the driver holds weights and sums,
whose size depends on classes and features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlab.session import dropped, materialised
from flowlab.tables import is_few, ref, ship, task_sums, tree_sum, unpack

# Rows of one stochastic step, halvings of a Newton step, passes without progress before descent ends.
BATCH, HALVINGS, PATIENCE = 32, 30, 5
# Rows whose kernel values are made at a time.
BLOCK = 4 * BATCH
# Up to so many vectors are multiplied with the map one by one.
FEW = 6
# Rows are long if their mean squared length is beyond this many times that of standardised ones.
LONG = 2.0


def _table(rows, features, code, weight):
    """Features, class code and weight of the rows with a code, written once for all passes."""
    weight = (ref(weight) if weight else F.lit(1.0)).cast("double")
    return materialised(rows.select(*[ref(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                                    code.cast("int").alias("code"), weight.alias("weight")).where("code >= 0"), "hinge")


def _parts(pdf, p, k):
    """Rows with a last column of ones, signs per class (+1 for the row's own), weights."""
    values = pdf.to_numpy(dtype=np.float64)
    x = np.concatenate([values[:, :p], np.ones((len(values), 1))], axis=1)
    sign = np.where(values[:, p].astype(int)[:, None] == np.arange(k), 1.0, -1.0)
    return x, sign, values[:, p + 1]


def squared_hinge(rows, features, code, k, cost, max_iter=100, tol=1e-8, weight=None):
    """Weights and intercepts (k rows) that minimise, per class, half the squared length of both and
    ``cost`` times the sum of squared hinge losses. ``code`` is a column with class numbers.

    Newton steps with halving, each class for itself; ends when every gradient is below ``tol`` times its
    first length."""
    p = len(features)
    table = _table(rows, features, code, weight)
    columns, few = [*[f"x{i}" for i in range(p)], "code", "weight"], is_few(table)

    def sums_at(w):
        def sums(pdf):
            x, sign, mass = _parts(pdf, p, k)
            slack = np.maximum(1.0 - sign * (x @ w.T), 0.0)
            bent = [x[slack[:, c] > 0] * mass[slack[:, c] > 0, None] for c in range(k)]
            return {"loss": (mass[:, None] * slack ** 2).sum(0), "gradient": (-2.0 * (mass[:, None] * slack * sign).T @ x).ravel(),
                    "curvature": np.stack([2.0 * b.T @ x[slack[:, c] > 0] for c, b in enumerate(bent)]).ravel()}

        total = tree_sum(table, columns, sums, few)
        if not total:
            raise ValueError("no rows to fit on")
        return (0.5 * (w ** 2).sum(1) + cost * total["loss"], w + cost * total["gradient"].reshape(k, p + 1),
                np.eye(p + 1) + cost * total["curvature"].reshape(k, p + 1, p + 1))

    w = np.zeros((k, p + 1))
    loss, gradient, curvature = sums_at(w)
    least = tol * np.maximum(np.linalg.norm(gradient, axis=1), 1e-300)
    step, length = -np.linalg.solve(curvature, gradient[..., None])[..., 0], np.ones(k)
    for _ in range(max_iter):
        live = (np.linalg.norm(gradient, axis=1) > least) & (length > 0.5 ** HALVINGS)
        if not live.any():
            break
        tried = np.where(live[:, None], w + length[:, None] * step, w)
        new_loss, new_gradient, new_curvature = sums_at(tried)
        better = live & (new_loss <= loss + 1e-4 * length * (gradient * step).sum(1))
        w = np.where(better[:, None], tried, w)
        loss = np.where(better, new_loss, loss)
        gradient = np.where(better[:, None], new_gradient, gradient)
        step = np.where(better[:, None], -np.linalg.solve(new_curvature, new_gradient[..., None])[..., 0], step)
        length = np.where(better, 1.0, np.where(live, length / 2, length))
    dropped(table)
    return w[:, :p], w[:, p]


def averaged_descent(rows, features, code, k, alpha, max_iter=1000, tol=1e-3, weight=None, seed=0, mapping=None):
    """Weights and intercepts (k rows) for the mean hinge loss plus ``alpha`` halves of the weights' squared
    length, by averaged stochastic gradient descent.

    The step is 1 / (alpha * (start + rows a task has seen)). If the rows are longer than standardised ones, the
    first step is one over their mean squared length, so that it moves no margin by more than about one; else the
    loss begins many orders above its minimum and falls too slowly ever to end. A pass starts every task from the averaged
    weights of the one before; the result is the average over all steps of the last pass. Ends after ``PATIENCE``
    passes that lower the mean loss by less than ``tol``. With ``mapping`` (a ``KernelMap``) the machine is linear
    in the mapped rows, but only their kernel values are made, anew in every pass (see ``KernelMachine``)."""
    p = len(features)
    dims = p if mapping is None else len(mapping.weights)
    shipped = ship(rows.sparkSession, mapping)
    table = _table(rows, features, code, weight)
    columns, few = [*[f"x{i}" for i in range(p)], "code", "weight"], is_few(table)
    start = alpha ** 0.25 / alpha  # so that the first step suits weights of the length the penalty allows
    if mapping is None:
        length = table.agg(F.avg(sum((F.col(c) * F.col(c) for c in columns[:p]), F.lit(1.0)))).first()[0] or 0.0
        if length > LONG * (p + 1):
            start = max(start, length / alpha)
    w, best, idle, seen, average = np.zeros((k, dims + 1)), np.inf, 0, 0.0, None
    for epoch in range(max_iter):
        def run(batches, w=w, seen=seen, epoch=epoch):
            rng = np.random.default_rng([seed, epoch])
            if mapping is not None:
                machine = KernelMachine(w, unpack(shipped))
            else:
                machine = LinearMachine(w)
            total, loss, steps = 0, np.zeros(1), 0
            for pdf in batches:
                x, sign, mass = _parts(pdf, p, k)
                order = rng.permutation(len(x))
                x, sign, mass = x[order], sign[order], mass[order, None]
                pull, slacks = sign * mass, np.empty_like(sign)
                for a, near in machine.steps(x):
                    slack = slacks[a: a + BATCH]
                    np.subtract(1.0, sign[a: a + BATCH] * machine.margins(near), out=slack)
                    rate = len(near) / (alpha * (start + seen + total))
                    machine.step(max(0.0, 1.0 - rate * alpha), rate / len(near), (slack > 0) * pull[a: a + BATCH], near)
                    total += len(near)
                    steps += 1
                loss += (np.maximum(slacks, 0.0) * mass).sum()
            if not total:
                return {}
            own, added = machine.ended()
            return {"weights": total * own.ravel(), "mean": total * (added / steps).ravel(), "loss": loss,
                    "rows": np.array([total]), "tasks": np.ones(1)}

        total = task_sums(table, columns, run, few)
        if not total:
            raise ValueError("no rows to fit on")
        n = total["rows"][0]
        w, average = (total[key].reshape(k, dims + 1) / n for key in ("weights", "mean"))
        seen += n / total["tasks"][0]
        loss = total["loss"][0] / n
        idle = idle + 1 if loss > best - tol else 0
        best = min(best, loss)
        if idle >= PATIENCE:
            break
    dropped(table)
    weights = average[:, :dims] if mapping is None else average[:, :dims] @ mapping.weights
    return weights, average[:, dims]


class LinearMachine:
    """Weights and intercepts (k rows) that a task moves, on the rows as they are."""

    def __init__(self, w):
        self.own, self.added = w.copy(), np.zeros_like(w)

    def steps(self, x):
        """The rows of every step with their first row."""
        for a in range(0, len(x), BATCH):
            yield a, x[a: a + BATCH]

    def margins(self, near):
        return near @ self.own.T

    def step(self, keep, rate, pull, near):
        """Shrink the weights by ``keep`` and add the rows, ``rate`` times the pull of each on each class."""
        self.own[:, :-1] *= keep
        self.own += rate * pull.T @ near
        self.added += self.own

    def ended(self):
        """The weights, and the sum of the weights after every step."""
        return self.own, self.added


class KernelMachine:
    """The same on mapped rows, of which only the kernel values are made. The weights of mapped rows are kept as sums
    of kernel values; ``seen_by`` is what they are for the kernel values of a row, and rows that pull move it by
    the products of the map with their kernel values. Between such rows all weights only shrink, which one number
    tells: ``scale``; ``scales`` is its sum over the steps since a row last pulled, ``still`` their number."""

    def __init__(self, w, mapping):
        self.added, self.scale, self.scales, self.still = np.zeros_like(w), 1.0, 0.0, 0
        self.own, self.mapping, self.gram = w.copy(), mapping, mapping.weights @ mapping.weights.T
        self.seen_by = w[:, :-1] @ mapping.weights @ mapping.weights.T
        self.values = np.empty((BLOCK, len(mapping.weights)))

    def steps(self, x):
        for first in range(0, len(x), BLOCK):
            block = self.mapping.values(x[first: first + BLOCK, :-1], self.values[:len(x) - first])
            for a in range(0, len(block), BATCH):
                yield first + a, block[a: a + BATCH]

    def margins(self, near):
        return self.scale * (self.seen_by @ near.T).T + self.own[:, -1]

    def step(self, keep, rate, pull, near):
        self.scale *= keep
        if pull.any():
            self.ended()
            rows, classes = np.flatnonzero(pull.any(axis=1)), np.flatnonzero(pull.any(axis=0))
            near, push = near[rows], rate * pull[rows].T
            moves = push @ near
            self.own[:, :-1] += moves
            self.own[:, -1] += push.sum(axis=1)
            if len(rows) < len(classes):
                self.seen_by += push @ self._products(near)
            else:
                self.seen_by[classes] += self._products(moves[classes])
        self.scales += self.scale
        self.still += 1

    def ended(self):
        self.added[:, :-1] += self.scales * self.own[:, :-1]
        self.added[:, -1] += self.still * self.own[:, -1]
        self.own[:, :-1] *= self.scale
        self.seen_by *= self.scale
        self.scale, self.scales, self.still = 1.0, 0.0, 0
        return self.own, self.added

    def _products(self, vectors):
        """The products of the map with vectors; a few are faster one by one."""
        return np.stack([self.gram @ v for v in vectors]) if len(vectors) <= FEW else vectors @ self.gram
