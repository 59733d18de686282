import numpy as np
import pandas as pd
import pytest

from flowlab.operators import forest, models

FEATURES = ["a", "b", "c"]


def rows(spark, n=400):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 9, (n, 3)).astype(float), columns=FEATURES)
    pdf["label"] = np.where(pdf.a < 4, "x", np.where(pdf.b > 5, "y", "z"))
    return pdf, spark.createDataFrame(pdf.assign(id=range(n)))


def test_equal_rows_are_one_row_with_their_number(spark):
    _, df = rows(spark)
    many = df
    for _ in range(3):
        many = many.union(many)
    model = forest.Forest.roots(["x", "y", "z"], [np.arange(8) + 0.5] * 3, 5)
    from pyspark.sql import functions as F
    coded = many.select(*FEATURES, F.lit(0).alias("_code"), F.lit(1.0).alias("_weight"))
    table = forest._table(coded, model, False, 0).toPandas()
    assert len(table) == df.select(*FEATURES).distinct().count()
    assert sum(int(np.frombuffer(d, np.uint8)[0]) for d in table["draws"]) == 8 * 400


def test_a_single_tree_equals_a_plain_one(spark):
    """One tree takes all rows and features, so it has to find the rule; totals are those of the rows."""
    pdf, df = rows(spark)
    model = forest.fit(df, FEATURES, "label", ["x", "y", "z"], trees=1)
    assert model.feature[0] == 0 and model.edges[0][model.cut[0]] == 3.5
    assert model.totals[0].tolist() == [(pdf.label == c).sum() for c in "xyz"]
    guess = np.array(["x", "y", "z"])[model.scores(pdf[FEATURES].to_numpy()).argmax(axis=1)]
    assert (guess == pdf.label).all()
    assert (model.feature >= 0).sum() == 2


def test_best_splits_by_hand():
    """Classes 4:0, 0:2, 0:2 per bin: the first cut parts them; a lone bin can't be split."""
    sums = np.array([[[[4.0, 0], [0, 2], [0, 2]]], [[[1.0, 1], [0, 0], [0, 0]]]])
    candidate, cut, gain, left, right = forest.best_splits(sums)
    assert (candidate[0], cut[0]) == (0, 0) and gain[0] == pytest.approx(1.0)
    assert left[0].tolist() == [4, 0] and right[0].tolist() == [0, 4]
    assert gain[1] <= forest.LEAST_GAIN


def test_boxes_and_walks_agree(spark, monkeypatch):
    pdf, df = rows(spark)
    noisy = df.withColumn("label", df.label.substr(1, 1)).sample(1.0)
    model = forest.fit(noisy, FEATURES, "label", ["x", "y", "z"], trees=12, seed=3)
    x = pdf[FEATURES].to_numpy()
    by_box = model.scores(x)
    monkeypatch.setattr(forest, "BOXES", 0)
    assert np.allclose(by_box, model.scores(x)) and np.allclose(by_box.sum(axis=1), 12)
    assert model.importances().sum() == pytest.approx(1.0)


@pytest.mark.parametrize("mean", [1, 7, 5000])
def test_draws_are_poisson(mean):
    key = np.arange(2000, dtype=np.int64) * 7919
    draws = forest.poisson_draws(key, np.full(2000, mean), 50)
    assert draws.mean() == pytest.approx(mean, rel=0.02)
    assert draws.var() == pytest.approx(mean, rel=0.05)
    assert (draws == forest.poisson_draws(key, np.full(2000, mean), 50)).all()
    assert abs(np.corrcoef(draws[:, 0], draws[:, 1])[0, 1]) < 0.1


def test_small_groups_of_nodes_give_the_same_splits(spark, monkeypatch):
    """Nodes are looked at in groups whose sums fit a task; a single tree has the same splits in any group."""
    pdf, df = rows(spark)
    whole = forest.fit(df, FEATURES, "label", ["x", "y", "z"], trees=1)
    monkeypatch.setattr(forest, "HELD_VALUES", 1)
    one = forest.fit(df, FEATURES, "label", ["x", "y", "z"], trees=1)
    assert sorted(zip(whole.feature, whole.cut)) == sorted(zip(one.feature, one.cut))


def test_the_registry_grows_this_forest(spark):
    """Its table has at most as many rows as there are cells of bins, however many rows there are."""
    pdf, df = rows(spark)
    fitted = models.fit_model("random_forest", df, "label", ["id"], FEATURES, trees=8)
    assert isinstance(fitted.model, forest.Forest)
    out = fitted.predict(df).toPandas()
    assert (out.label == out.prediction).mean() > 0.97
    with pytest.raises(ValueError):
        forest.fit(df, FEATURES, "label", ["nobody"], trees=2)


def test_a_level_without_any_split(spark):
    """Rows alike in all features with two classes: no node can be split, and the roots are leaves."""
    df = spark.createDataFrame([(1.0, 2.0, c) for c in "xxy"], "a double, b double, label string")
    model = forest.fit(df, ["a", "b"], "label", ["x", "y"], trees=5)
    assert (model.feature == -1).all() and len(model.feature) == 5


@pytest.mark.parametrize("known", [1 << 22, 0])
def test_guesses_are_the_classes_of_the_scores(spark, monkeypatch, known):
    pdf, df = rows(spark)
    monkeypatch.setattr(forest, "KNOWN", known)
    model = forest.fit(df, FEATURES, "label", ["x", "y", "z"], trees=9, seed=2)
    x = np.random.default_rng(1).uniform(-2, 11, (3000, 3))
    guesses = forest.Guesses(model)
    for some in (x, x[::-1]):
        assert (guesses.of(model.binned(some)) == model.scores(some).argmax(axis=1)).all()
    monkeypatch.setattr(guesses, "told_apart", False)
    assert (guesses.of(model.binned(x)) == model.scores(x).argmax(axis=1)).all()
