import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlab.operators import hinge, models

NAMES = ["u", "v", "w"]


def frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) + 2.0 * np.eye(3)[code]
    rows = [(i, *map(float, r), int(c), "abc"[c], 1.0 + i % 3) for i, (r, c) in enumerate(zip(x, code))]
    return spark.createDataFrame(rows, "id long, u double, v double, w double, code int, label string, mass double").repartition(5)


def slope(pdf, w, b, cost, mass):
    """Gradient of the squared hinge objective, class by class, from all rows at once."""
    x = np.concatenate([pdf[NAMES].to_numpy(), np.ones((len(pdf), 1))], axis=1)
    full = np.concatenate([w, b[:, None]], axis=1)
    out = []
    for c, row in enumerate(full):
        y = np.where(pdf["code"] == c, 1.0, -1.0)
        slack = np.maximum(1 - y * (x @ row), 0)
        out.append(row - 2 * cost * ((mass * slack * y)[:, None] * x).sum(0))
    return np.array(out)


@pytest.mark.parametrize("weight", [None, "mass"])
def test_squared_hinge_is_at_its_minimum(spark, weight):
    df = frame(spark, 500, 1)
    w, b = hinge.squared_hinge(df, NAMES, F.col("code"), 3, 0.7, weight=weight)
    pdf = df.toPandas()
    mass = pdf["mass"].to_numpy() if weight else np.ones(len(pdf))
    assert np.abs(slope(pdf, w, b, 0.7, mass)).max() < 1e-5 * len(pdf)
    assert w.shape == (3, 3) and (w.argmax(1) == np.arange(3)).all()


def test_descent_comes_near_the_hinge_minimum(spark):
    df = frame(spark, 2_000, 2)
    pdf = df.toPandas()
    x = pdf[NAMES].to_numpy()
    w, b = hinge.averaged_descent(df, NAMES, F.col("code"), 3, 1e-2, max_iter=40)

    def objective(w, b):
        y = np.where(pdf["code"].to_numpy()[:, None] == np.arange(3), 1.0, -1.0)
        return np.maximum(1 - y * (x @ w.T + b), 0).mean(0) + 0.005 * (w ** 2).sum(1)

    best = np.full(3, np.inf)
    v, c = np.zeros((3, 3)), np.zeros(3)
    for t in range(1, 6_001):  # plain subgradient steps over all rows
        y = np.where(pdf["code"].to_numpy()[:, None] == np.arange(3), 1.0, -1.0)
        hit = (y * (x @ v.T + c) < 1) * y
        v, c = v - (1e-2 * v - hit.T @ x / len(x)) / (1e-2 * (t + 100)), c + hit.mean(0) / (1e-2 * (t + 100))
        best = np.minimum(best, objective(v, c))
    assert (objective(w, b) < best * 1.05 + 0.01).all()


def test_no_rows_and_registry(spark):
    df = frame(spark, 400, 3)
    with pytest.raises(ValueError, match="no rows"):
        hinge.squared_hinge(df.where("false"), NAMES, F.col("code"), 3, 1.0)
    with pytest.raises(ValueError, match="no rows"):
        hinge.averaged_descent(df.where("false"), NAMES, F.col("code"), 3, 1e-3)
    for name, options in (("sgd", dict(max_iter=15)), ("linear_svm", {}), ("svm", dict(landmarks=60))):
        out = models.fit_predict(name, df, df, "label", ["id"], NAMES, **options)
        assert out.where("prediction = label").count() > 320, name


def test_long_rows_end_near_the_minimum(spark, monkeypatch):
    passes, real = [], hinge.task_sums

    def seen(*args):
        passes.append(real(*args))
        return passes[-1]

    monkeypatch.setattr(hinge, "task_sums", seen)
    df = frame(spark, 2_000, 4).selectExpr("*", "u * 30000 AS x", "v * 30000 AS y", "w * 30000 AS z").coalesce(2)
    w, b = hinge.averaged_descent(df, ["x", "y", "z"], F.col("code"), 3, 1e-4, max_iter=100)
    assert len(passes) < 60
    pdf = df.toPandas()
    y = np.where(pdf["code"].to_numpy()[:, None] == np.arange(3), 1.0, -1.0)
    assert np.maximum(1 - y * (pdf[["x", "y", "z"]].to_numpy() @ w.T + b), 0).mean(0).sum() < 1.5


def test_kernel_values_alone_give_the_machine_of_mapped_rows(spark, monkeypatch):
    """Descent on kernel values has the weights of descent on rows that were mapped before, and maps none."""
    from flowlab.operators.reduce import KernelMap

    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 2))
    code = (x[:, 0] * x[:, 1] > 0).astype(int)
    mapping = KernelMap(x[:30], "rbf", 0.5)
    mapped = mapping.project(x)
    names = [f"z{i}" for i in range(mapped.shape[1])]
    plain = spark.createDataFrame(pd.DataFrame(mapped, columns=names).assign(code=code)).coalesce(1)
    raw = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(code=code)).coalesce(1)
    wanted = hinge.averaged_descent(plain, names, F.col("code"), 2, 1e-3, max_iter=4)
    monkeypatch.delattr(KernelMap, "project")
    found = hinge.averaged_descent(raw, ["a", "b"], F.col("code"), 2, 1e-3, max_iter=4, mapping=mapping)
    assert np.allclose(found[0], wanted[0], atol=1e-6) and np.allclose(found[1], wanted[1], atol=1e-6)
    scores = models.LinearScores([0, 1], *found, mapping).scores(x)
    assert np.allclose(scores, mapped @ wanted[0].T + wanted[1], atol=1e-5)
    assert (scores.argmax(axis=1) == code).mean() > 0.9


def test_powers_from_the_table_are_the_kernel():
    """Near, equal and far rows, in blocks of any length, with values written in place."""
    from flowlab.operators.reduce import KernelMap, kernel_values

    rng = np.random.default_rng(2)
    marks = rng.normal(size=(40, 3))
    x = np.concatenate([rng.normal(size=(300, 3)) * 3, marks, [[1e5, 0, 0], [0, -60.0, 0]]])
    mapping, out = KernelMap(marks, "rbf", 0.4), np.empty((len(x), 40))
    assert mapping.values(x, out) is out
    wanted = kernel_values("rbf", x, marks, 0.4)
    assert np.allclose(out, wanted, rtol=1e-11, atol=1e-300) and out[-2].max() == 0.0
    assert (mapping.values(x) == out).all()
    assert np.allclose(KernelMap(marks, "poly", 0.4).values(x), kernel_values("poly", x, marks, 0.4))


@pytest.mark.parametrize("few", [0, 6])
def test_only_rows_that_pull_are_multiplied_with_the_map(monkeypatch, few):
    """Steps without a pull only shrink; weights and their sum over all steps are those of mapped rows."""
    from flowlab.operators.reduce import KernelMap

    monkeypatch.setattr(hinge, "FEW", few)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(160, 2)), np.ones((160, 1))], axis=1)
    mapping = KernelMap(x[:25, :2], "rbf", 0.5)
    mapped = np.concatenate([mapping.project(x[:, :2]), np.ones((160, 1))], axis=1)
    width, products = mapping.weights.shape[1], []
    kernel, plain = hinge.KernelMachine(np.zeros((3, 26)), mapping), hinge.LinearMachine(np.zeros((3, width + 1)))
    real = kernel._products
    monkeypatch.setattr(kernel, "_products", lambda vectors: products.append(len(vectors)) or real(vectors))
    pulls = np.zeros((160, 3))
    pulls[[3, 4, 70], 1], pulls[[4, 70, 90], 0], pulls[70, 2] = -1.0, 2.0, 0.5
    for (a, near), (_, rows) in zip(kernel.steps(x), plain.steps(mapped)):
        assert np.allclose(kernel.margins(near), plain.margins(rows), atol=1e-8)
        for machine, some in ((kernel, near), (plain, rows)):
            machine.step(0.9, 0.3, pulls[a: a + len(some)], some)
    assert products == [2, 2]  # batches 0 and 2: two rows or two classes, and two rows of three classes
    for found, wanted in zip(kernel.ended(), plain.ended()):
        assert np.allclose(found[:, :-1] @ mapping.weights, wanted[:, :-1], atol=1e-8)
        assert np.allclose(found[:, -1], wanted[:, -1])
