import numpy as np
import pytest

from flowlab.operators import boosting, models
from flowlab.operators.boosting import Growth


def rings(n, seed):
    """Three classes that no single cut separates, a column without use and one with few values."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    few = rng.integers(0, 4, n)
    label = np.where(x[:, 0] * x[:, 1] > 0, np.where(few > 1, "a", "b"), "c")
    return x, few, label


def frame(spark, n, seed):
    x, few, label = rings(n, seed)
    rows = [(i, *map(float, r), float(f), str(c)) for i, (r, f, c) in enumerate(zip(x, few, label))]
    return spark.createDataFrame(rows, "id long, u double, v double, w double, few double, label string").repartition(4)


FEATURES = ["u", "v", "w", "few"]


def plain_fit(model, bins, code, growth):
    """The same trees from all rows at once, node by node in recursion (levels only)."""
    scores = np.tile(model.priors, (len(bins), 1))
    rounds = []
    for _ in range(growth.rounds):
        p = boosting.probabilities(scores)
        step = np.zeros_like(scores)
        splits = []
        for c in range(len(model.classes)):
            g, h = p[:, c] - (code == c), p[:, c] * (1 - p[:, c])

            def grow(rows, at, depth, c=c, g=g, h=h):
                best = (boosting.LEAST_GAIN, None, None)
                for f in range(bins.shape[1]) if depth < growth.depth else []:
                    for cut in range(len(model.edges[f])):
                        left = bins[rows, f] <= cut
                        a, b = rows[left], rows[~left]
                        if min(h[a].sum(), h[b].sum()) < growth.least_curvature:
                            continue
                        gain = sum(s * g[x].sum() ** 2 / (h[x].sum() + growth.ridge) for s, x in ((1, a), (1, b), (-1, rows)))
                        if gain > best[0] * (1 + 1e-9):
                            best = gain, f, cut
                if best[1] is None:
                    step[rows, c] = -growth.step * g[rows].sum() / (h[rows].sum() + growth.ridge)
                    return
                splits.append((c, at, *best[1:]))
                left = bins[rows, best[1]] <= best[2]
                grow(rows[left], 2 * at + 1, depth + 1)
                grow(rows[~left], 2 * at + 2, depth + 1)

            grow(np.arange(len(bins)), 0, 0)
        scores += step
        rounds.append(sorted(splits))
    return rounds, scores


def test_levels_equal_plain_boosting(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df = frame(spark, 400, 1)
    growth = Growth(rounds=3, depth=2, step=0.3, ridge=1.0, least_curvature=1.0)
    model = boosting.fit(df, FEATURES, "label", ["a", "b", "c"], growth, max_bins=16)
    assert len(model.edges[3]) == 3 and model.edges[3].tolist() == [0.0, 1.0, 2.0]
    rows = df.orderBy("id").toPandas()
    bins = model.binned(rows[FEATURES].to_numpy())
    code = rows["label"].map({"a": 0, "b": 1, "c": 2}).to_numpy()
    rounds, scores = plain_fit(model, bins, code, growth)
    got = [sorted((c, n, int(t.feature[n]), int(t.cut[n])) for c, t in enumerate(trees) for n in np.flatnonzero(t.feature >= 0).tolist())
           for trees in model.rounds]
    assert got == rounds
    assert np.allclose(model.scores(rows[FEATURES].to_numpy()), scores)


@pytest.mark.parametrize("few", [True, False])
def test_policies(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(boosting, "FAN_IN", 1)
    train, test = frame(spark, 1_200, 2), frame(spark, 400, 3)
    for policy, ridge in (("levels", 1.0), ("leaves", 0.0), ("symmetric", 3.0)):
        model = boosting.fit(train, FEATURES, "label", ["a", "b", "c"],
                             Growth(rounds=8, depth=4, step=0.4, ridge=ridge, least_curvature=1e-3, policy=policy, leaves=6), max_bins=32)
        rows = test.toPandas()
        guess = np.array(["a", "b", "c"])[model.scores(rows[FEATURES].to_numpy()).argmax(1)]
        assert (guess == rows["label"]).mean() > 0.85, policy
        for tree in (t for trees in model.rounds for t in trees):
            if policy == "leaves":
                assert (tree.feature >= 0).sum() <= 5
            if policy == "symmetric":
                for level in range(4):
                    own = {(f, c) for f, c in zip(tree.feature[2 ** level - 1:2 ** (level + 1) - 1], tree.cut[2 ** level - 1:2 ** (level + 1) - 1]) if f >= 0}
                    assert len(own) <= 1


def test_weights_count_like_repeated_rows(spark):
    df = frame(spark, 300, 4).selectExpr("id", "label", "few", "round(u) AS u", "round(v) AS v")
    twice = df.unionByName(df.where("label = 'a'"))
    weighted = df.selectExpr("*", "if(label = 'a', 2.0, 1.0) AS weight")
    growth, names = Growth(rounds=3, depth=2), ["u", "v", "few"]
    a = boosting.fit(twice, names, "label", ["a", "b", "c"], growth)
    b = boosting.fit(weighted, names, "label", ["a", "b", "c"], growth, weight="weight")
    x = df.toPandas()[names].to_numpy()
    assert np.allclose(a.scores(x), b.scores(x))


def test_refused_and_pure(spark):
    df = frame(spark, 100, 5)
    with pytest.raises(ValueError, match="two classes"):
        boosting.fit(df.where("label = 'a'"), FEATURES, "label", ["a", "b"], Growth(rounds=1))
    with pytest.raises(ValueError, match="policy"):
        boosting.fit(df, FEATURES, "label", ["a", "b"], Growth(policy="rows"))
    with pytest.raises(ValueError, match="bytes"):
        boosting.fit(df, FEATURES, "label", ["a", "b"], Growth(), max_bins=300)
    same = boosting.fit(df.withColumn("u", df["few"] * 0), ["u"], "label", ["a", "b", "c"], Growth(rounds=3))
    assert same.rounds == []
    table = boosting.tree_table(boosting.fit(df, FEATURES, "label", ["a", "b", "c"], Growth(rounds=1, depth=1)), FEATURES, spark)
    assert table.count() == 3
    out = models.fit_predict("lightgbm", df, df, "label", ["id"], FEATURES, rounds=3)
    assert out.where("prediction = label").count() > 60


def test_rows_alike_in_all_bins_are_one(spark, monkeypatch):
    written = []

    def seen(df, name="table"):
        written.append(real(df, name))
        return written[-1]

    real = boosting.materialised
    monkeypatch.setattr(boosting, "materialised", seen)
    monkeypatch.setattr(boosting, "dropped", lambda *tables: None)
    df = frame(spark, 300, 6).selectExpr("id", "label", "few", "round(u) AS u", "round(v) AS v")
    many, names, growth = df.crossJoin(spark.range(20).select("id").withColumnRenamed("id", "copy")), ["u", "v", "few"], Growth(rounds=2, depth=2)
    model = boosting.fit(many, names, "label", ["a", "b", "c"], growth)
    cells = df.select("label", *names).distinct().count()
    assert written[0].count() == cells < 300
    assert written[0].selectExpr("sum(weight)").first()[0] == 6_000
    weighted = boosting.fit(df.selectExpr("*", "20.0 AS weight"), names, "label", ["a", "b", "c"], growth, weight="weight")
    x = df.toPandas()[names].to_numpy()
    assert np.allclose(model.scores(x), weighted.scores(x))
