"""A small feed-forward network trained by mini-batches on rows that stay where they are.

In a pass every task goes through its rows in small batches from the same weights (Adam steps), and the
tasks' weights and step statistics are averaged by rows. A tenth of the rows is held out; its accuracy
under the weights a pass starts from is counted in the same pass, training ends when it hasn't risen for
a while, and the best weights are kept."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from flowlab.session import dropped, materialised
from flowlab.tables import is_few, ref, task_sums

# Decay of the step statistics (first and second moment) and what keeps a step finite.
DECAY, LEAST = (0.9, 0.999), 1e-8
# One row in so many is held out.
HELD = 10


@dataclass
class Network:
    """Weights of all layers in one vector; rectified hidden layers, softmax at the end."""
    classes: list
    sizes: list
    weights: np.ndarray
    accuracies: list = field(default_factory=list)

    def layers(self, flat=None):
        flat, at, out = self.weights if flat is None else flat, 0, []
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at: at + a * b].reshape(a, b), flat[at + a * b: at + a * b + b]))
            at += a * b + b
        return out

    def scores(self, x):
        layers = self.layers()
        for w, b in layers[:-1]:
            x = np.maximum(x @ w + b, 0.0)
        return x @ layers[-1][0] + layers[-1][1]

    def gradient(self, x, code, penalty):
        """Gradient of the mean log loss plus ``penalty`` halves of the squared weights per row."""
        layers, values, n = self.layers(), [x], len(code)
        for w, b in layers[:-1]:
            h = values[-1] @ w
            h += b
            values.append(np.maximum(h, 0.0, out=h))
        delta = values[-1] @ layers[-1][0]
        delta += layers[-1][1]
        delta -= delta.max(axis=1, keepdims=True)
        np.exp(delta, out=delta)
        delta /= delta.sum(axis=1, keepdims=True)
        delta[np.arange(n), code] -= 1.0
        delta /= n
        flat = np.empty_like(self.weights)
        parts = self.layers(flat)
        for i in range(len(layers) - 1, -1, -1):
            w, value = layers[i][0], values[i]
            np.matmul(value.T, delta, out=parts[i][0])
            parts[i][0][...] += penalty / n * w
            delta.sum(axis=0, out=parts[i][1])
            if i:  # the rows themselves have no gradient
                delta = delta @ w.T
                delta *= value > 0
        return flat


def start(sizes, seed):
    """Uniform weights within the square root of 6 over fan-in plus fan-out, for biases too."""
    if min(sizes) < 1:
        raise ValueError("every layer needs a unit")
    rng = np.random.default_rng(seed)
    bound = [np.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return np.concatenate([rng.uniform(-r, r, a * b + b) for r, a, b in zip(bound, sizes, sizes[1:])])


def fit(rows, features, code, ids, classes, hidden=(64, 32), max_iter=60, tol=1e-4, patience=10, rate=1e-3, batch=200,
        penalty=1e-4, seed=0):
    """A network for the rows whose ``code`` (a column of class numbers) is not negative. One row in ``HELD``,
    by a hash of its ids, only judges. Ends after ``max_iter`` passes, or when the held-out accuracy hasn't
    risen by ``tol`` for ``patience`` passes; the weights with the best one are kept (``accuracies`` tells
    that of every pass). Without held-out rows training runs all passes."""
    p, k = len(features), len(classes)
    model = Network(list(classes), [p, *hidden, k], start([p, *hidden, k], seed))
    held = F.pmod(F.xxhash64(*[ref(c) for c in ids], F.lit(seed)), F.lit(HELD)) == 0
    table = materialised(rows.select(*[ref(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                                     code.cast("int").alias("code"), held.cast("int").alias("held")).where("code >= 0"), "network")
    columns, few = [*[f"x{i}" for i in range(p)], "code", "held"], is_few(table)
    state = np.zeros((2, len(model.weights)))
    best, best_weights, idle, steps = -1.0, model.weights, 0, 0.0
    for epoch in range(max_iter + 1):
        def run(batches, weights=model.weights, state=state, epoch=epoch, steps=steps):
            own, moments, t, n = Network(classes, model.sizes, weights.copy()), state.copy(), steps, 0
            judge, judged = Network(classes, model.sizes, weights), np.zeros(2)
            rng = np.random.default_rng([seed, epoch])
            for pdf in batches:
                values = pdf.to_numpy(dtype=np.float64)
                x, own_code, apart = values[:, :p], values[:, p].astype(int), values[:, p + 1] > 0
                if apart.any():
                    judged += [(judge.scores(x[apart]).argmax(1) == own_code[apart]).sum(), apart.sum()]
                x, own_code = x[~apart], own_code[~apart]
                order = rng.permutation(len(x))
                for a in range(0, len(x) if epoch < max_iter else 0, batch):
                    at = order[a: a + batch]
                    g = own.gradient(x[at], own_code[at], penalty)
                    t += 1
                    moments[0] += (1 - DECAY[0]) * (g - moments[0])
                    moments[1] += (1 - DECAY[1]) * (g * g - moments[1])
                    first, second = moments[0] / (1 - DECAY[0] ** t), moments[1] / (1 - DECAY[1] ** t)
                    own.weights -= rate * first / (np.sqrt(second) + LEAST)
                    n += len(at)
            out = {"judged": judged}
            if n:
                out |= {"weights": n * own.weights, "moments": n * moments.ravel(), "n": np.array([n, n * t])}
            return out

        total = task_sums(table, columns, run, few)
        right, judged = total.get("judged", np.zeros(2))
        if judged:
            model.accuracies.append(right / judged)
            if model.accuracies[-1] > best:
                best_weights = model.weights
            idle = 0 if model.accuracies[-1] > best + tol else idle + 1
            best = max(best, model.accuracies[-1])
            if idle > patience:
                break
        if epoch == max_iter:
            break
        if "n" not in total:
            raise ValueError("no rows to fit on")
        n = total["n"][0]
        model.weights, state, steps = total["weights"] / n, total["moments"].reshape(2, -1) / n, total["n"][1] / n
    if best >= 0:
        model.weights = best_weights
    dropped(table)
    return model
