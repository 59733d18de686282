import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import models, network

NAMES = ["u", "v"]


def frame(spark, n, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    code = ((x ** 2).sum(1) > 1.4).astype(int)
    code = np.where(rng.random(n) < noise, 1 - code, code)
    rows = [(i, *map(float, r), int(c), "in" if c == 0 else "out") for i, (r, c) in enumerate(zip(x, code))]
    return spark.createDataFrame(rows, "id long, u double, v double, code int, label string").repartition(4)


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    sizes = [3, 4, 3]
    net = network.Network(list("abc"), sizes, network.start(sizes, 1))
    x, code, penalty = rng.normal(size=(7, 3)), rng.integers(0, 3, 7), 0.3

    def loss(flat):
        own = network.Network(list("abc"), sizes, flat)
        out = own.scores(x)
        log = out - np.log(np.exp(out).sum(1, keepdims=True))
        return -log[np.arange(7), code].mean() + penalty / 7 / 2 * sum((w ** 2).sum() for w, _ in own.layers())

    got = net.gradient(x, code, penalty)
    for i in range(len(got)):
        step = np.zeros(len(got))
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(net.weights + step) - loss(net.weights - step)) / 2e-6, abs=1e-6)


def test_stops_early_with_the_best_weights(spark):
    """Half the labels are wrong at random: accuracy soon stops rising."""
    df = frame(spark, 1_500, 1, noise=0.4)
    model = network.fit(df, NAMES, F.col("code"), ["id"], ["in", "out"], hidden=(16,), max_iter=200, patience=4, rate=1e-2, batch=50)
    assert 6 <= len(model.accuracies) < 150
    best = int(np.argmax(model.accuracies))
    assert best < len(model.accuracies) - 1
    held = df.where(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(network.HELD)) == 0).toPandas()
    accuracy = (model.scores(held[NAMES].to_numpy()).argmax(1) == held["code"]).mean()
    assert accuracy == pytest.approx(max(model.accuracies))


def test_learns_a_ring_and_refuses_nothing_to_learn(spark):
    train, test = frame(spark, 2_000, 2), frame(spark, 500, 3)
    out = models.fit_predict("mlp", train, test, "label", ["id"], NAMES, max_iter=40)
    assert out.where("prediction = label").count() > 430
    with pytest.raises(ValueError, match="no rows"):
        network.fit(train.where("false"), NAMES, F.col("code"), ["id"], ["in", "out"])
    with pytest.raises(ValueError, match="unit"):
        network.fit(train, NAMES, F.col("code"), ["id"], ["in", "out"], hidden=(-1,))


def test_gradient_matches_differences_of_the_loss():
    rng = np.random.default_rng(5)
    x, code = rng.normal(size=(20, 3)), rng.integers(0, 3, 20)
    sizes, weights = [3, 6, 4, 3], network.start([3, 6, 4, 3], 1)

    def loss(w):
        out = network.Network([0, 1, 2], sizes, w).scores(x)
        return (np.log(np.exp(out).sum(axis=1)) - out[np.arange(20), code]).mean()

    found = network.Network([0, 1, 2], sizes, weights).gradient(x, code, 0.0)
    near = [(loss(weights + 1e-6 * e) - loss(weights - 1e-6 * e)) / 2e-6 for e in np.eye(len(weights))]
    assert np.allclose(found, near, atol=1e-6)
