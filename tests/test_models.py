import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlab.operators import discriminant, models, prep, reduce, sampling
from flowlab.plans import studies

FEATURES = ["a", "b", "c"]
# Small settings for the unit tests only.
QUICK = {
    "decision_tree": dict(max_depth=8), "random_forest": dict(trees=20, max_depth=8),
    "hist_gb": dict(rounds=5, max_depth=3), "xgboost": dict(rounds=5, max_depth=3),
    "lightgbm": dict(rounds=5, max_depth=3), "catboost": dict(rounds=5, max_depth=3),
    "adaboost": dict(rounds=10), "mlp": dict(max_iter=30), "logistic": dict(max_iter=50),
    "sgd": dict(max_iter=20), "linear_svm": dict(max_iter=20), "svm": dict(landmarks=80, max_iter=20),
}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    parts = []
    for name, n, centre in (("p", 300, (0, 0, 0)), ("q", 200, (3, 0, 1)), ("r", 100, (0, 4, -2))):
        parts.append(pd.DataFrame(rng.normal(size=(n, 3)) + centre, columns=FEATURES).assign(label=name))
    pdf = pd.concat(parts, ignore_index=True).assign(id=lambda d: np.arange(len(d)))
    df = spark.createDataFrame(pdf)
    split = sampling.stratified_split(df, "label", ["id"], 0.4).cache()
    return split.where("is_train"), split.where("not is_train")


@pytest.mark.parametrize("name", sorted(models.REGISTRY))
def test_every_model_beats_the_majority(blobs, name):
    train, test = blobs
    scored = models.fit_predict(name, train, test, "label", ["id"], FEATURES, **QUICK.get(name, {}))
    row = scored.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc")).first()
    assert row["n"] == test.count()
    assert row["acc"] > 0.7
    assert not [c for c in scored.columns if c.startswith("_")]


def test_weighted_tree_accepts_class_weights(blobs):
    train, test = blobs
    scored = models.fit_predict("decision_tree", train, test, "label", ["id"], FEATURES, class_weight=True, max_depth=5)
    assert scored.where("prediction is null").count() == 0


def matrix(df, columns=FEATURES):
    return df.orderBy("id").select(*columns).toPandas().to_numpy()


def test_moments_match_numpy(blobs):
    train, _ = blobs
    m = discriminant.class_moments(train, "label", FEATURES)
    pdf = train.toPandas()
    for i, c in enumerate(m.classes):
        part = pdf[pdf.label == c][FEATURES].to_numpy()
        assert m.counts[i] == len(part)
        assert np.allclose(m.means[i], part.mean(axis=0))
        assert np.allclose(m.scatters[i] / len(part), np.cov(part.T, bias=True))


def test_linear_discriminant_is_the_bayes_rule_of_equal_gaussians(blobs):
    train, test = blobs
    m = discriminant.class_moments(train, "label", FEATURES)
    model = discriminant.LinearDiscriminant(m)
    pooled = m.scatters.sum(axis=0) / (m.counts.sum() - 3)
    x = matrix(test)
    inverse = np.linalg.inv(pooled)
    scores = np.stack([-0.5 * np.einsum("ij,jk,ik->i", x - mu, inverse, x - mu) + np.log(p)
                       for mu, p in zip(m.means, m.priors)], axis=1)
    assert (scores.argmax(axis=1) == model.scores(x).argmax(axis=1)).all()
    assert model.scalings.shape == (3, 2)


def test_identical_features_do_not_break_the_linear_discriminant(blobs):
    train, test = (d.withColumn("twin", F.col("a")) for d in blobs)
    scored = models.fit_predict("lda", train, test, "label", ["id"], [*FEATURES, "twin"])
    plain = models.fit_predict("lda", *blobs, "label", ["id"], FEATURES)
    a, b = ({r["id"]: r["prediction"] for r in t.collect()} for t in (scored, plain))
    assert a == b


def test_ladder_takes_the_first_shrinkage_that_works(spark):
    rows = [(float(i), float(i), "a") for i in range(10)] + [(float(i), 0.5 * i, "b") for i in range(10)]
    m = discriminant.class_moments(spark.createDataFrame(rows, "x double, y double, label string"), "label", ["x", "y"])
    with pytest.raises(ValueError):
        discriminant.QuadraticDiscriminant(m, 0.0)
    assert discriminant.fit_on_ladder(m)[1] == 0.1
    with pytest.raises(ValueError):
        discriminant.fit_on_ladder(m, ladder=(0.0,))


def test_linear_kernel_components_are_principal_components(blobs):
    train, test = blobs
    train, test = prep.prepare(train, [train, test], FEATURES)
    (_, kernel), _ = reduce.kernel_pca(train, [train, test], "label", ["id"], FEATURES, "linear", 3)
    (_, plain), _ = reduce.pca(train, [train, test], FEATURES, 3)
    a, b = (np.array([r["projected"] for r in t.orderBy("id").collect()]) for t in (kernel, plain))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-8)


def test_sigmoid_kernel_keeps_positive_directions_only():
    x = np.random.default_rng(0).normal(size=(60, 4))
    model = reduce.KernelComponents(x, "sigmoid", 15, gamma=0.5)
    assert (model.eigenvalues > 0).all()
    assert np.allclose(model.project(x).T @ model.project(x), np.diag(model.eigenvalues), atol=1e-8)


def test_largest_eigenpairs_come_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1600, 12)) * np.arange(1, 13)
    gram = reduce.kernel_values("rbf", x, x, 0.002)
    value, vector = reduce.top_eigenpairs(gram, 10)
    assert np.allclose(value, np.linalg.eigvalsh(gram)[::-1][:10], rtol=1e-7)
    assert np.allclose(gram @ vector, vector * value, atol=1e-6 * value[0])


def test_kernel_map_reproduces_the_kernel_on_its_landmarks():
    x = np.random.default_rng(0).normal(size=(40, 5))
    z = reduce.KernelMap(x, "rbf", 0.2).project(x)
    assert np.allclose(z @ z.T, reduce.kernel_values("rbf", x, x, 0.2), atol=1e-6)


def test_large_training_sets_use_a_stratified_landmark_sample(blobs):
    train, _ = blobs
    marks = reduce.landmark_rows(train, "label", ["id"], FEATURES, most=50)
    assert 50 <= len(marks) <= 53


def test_failed_run_keeps_its_row_and_others_go_on(blobs):
    train, test = blobs
    df = train.unionByName(test)
    table = studies.compare_classifiers(df, "label", ["id"], FEATURES, ["mlp", "naive_bayes"], [0.4],
                                        options={"mlp": dict(hidden=[-1])})
    status = {r["model"]: r["status"] for r in table.collect()}
    assert status["naive_bayes"] == "ok" and status["mlp"] != "ok"


def test_a_stopped_study_resumes_from_its_table(blobs, tmp_path, monkeypatch):
    df = blobs[0].unionByName(blobs[1])
    path = str(tmp_path / "runs")
    names = ["naive_bayes", "lda", "qda"]
    real, seen = models.fit_predict, []

    def stopping(name, *args, **options):
        seen.append(name)
        if name == "qda" and seen.count("qda") == 1:
            raise KeyboardInterrupt
        return real(name, *args, **options)

    monkeypatch.setattr(models, "fit_predict", stopping)
    with pytest.raises(KeyboardInterrupt):
        studies.compare_classifiers(df, "label", ["id"], FEATURES, names, [0.4], table=path)
    rows = studies.compare_classifiers(df, "label", ["id"], FEATURES, names, [0.4], table=path).collect()
    assert seen == ["naive_bayes", "lda", "qda", "qda"]
    assert sorted(r["model"] for r in rows) == sorted(names)
    assert all(r["status"] == "ok" and r["recall::p"] > 0.7 and r["f1::r"] > 0.7 for r in rows)


def test_boosted_stumps_match_plain_boosting(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(400, 2)).astype(float)
    y = np.where(x[:, 0] + rng.normal(size=400) > 8, "c", np.where(x[:, 1] > 5, "b", "a"))
    pdf = pd.DataFrame({"id": np.arange(400), "u": x[:, 0], "v": x[:, 1], "label": y})
    df = spark.createDataFrame(pdf)
    scored = models.fit_predict("adaboost", df, df, "label", ["id"], ["u", "v"], rounds=6)
    got = np.array([r["prediction"] for r in scored.orderBy("id").collect()])

    names, weight, votes = np.array(["a", "b", "c"]), np.ones(400), np.zeros((400, 3))
    hits = y[:, None] == names
    for _ in range(6):
        best = None
        for f in range(2):
            for cut in np.unique(x[:, f]):
                left = x[:, f] <= cut
                sides = [(weight[m, None] * hits[m]).sum(axis=0) for m in (left, ~left)]
                purity = sum((s ** 2).sum() / max(s.sum(), 1e-300) for s in sides)
                if best is None or purity > best[0] * (1 + 1e-12):
                    best = purity, np.where(left, sides[0].argmax(), sides[1].argmax() if sides[1].sum() > 0 else sides[0].argmax())
        guess = best[1]
        miss = names[guess] != y
        error = weight[miss].sum() / weight.sum()
        alpha = np.log((1 - error) / error) + np.log(2)
        votes[np.arange(400), guess] += alpha
        weight = weight * np.where(miss, np.exp(alpha), 1.0)
    assert (got == names[votes.argmax(axis=1)]).all()


def test_stumps_keep_rows_alike_once(spark, monkeypatch):
    written, real = [], models.materialised

    def seen(df, *name):
        written.append(real(df, *name))
        return written[-1]

    monkeypatch.setattr(models, "materialised", seen)
    monkeypatch.setattr(models, "dropped", lambda *tables: None)
    df = spark.range(2_000).selectExpr("id", "cast(id % 4 as double) AS u", "cast(id % 3 as double) AS v",
                                       "if(id % 4 > 1, 'a', if(id % 3 = 0, 'b', 'c')) AS label")
    out = models.fit_predict("adaboost", df, df, "label", ["id"], ["u", "v"], rounds=5)
    assert out.where("prediction = label").count() == 2_000
    assert [t.count() for t in written] == [12]


def test_finished_runs_are_skipped(blobs):
    train, test = blobs
    df = train.unionByName(test)
    first = studies.compare_classifiers(df, "label", ["id"], FEATURES, ["lda"], [0.4]).cache()
    second = studies.compare_classifiers(df, "label", ["id"], FEATURES, ["lda", "naive_bayes"], [0.4], done=first)
    rows = {r["model"]: r for r in second.collect()}
    assert set(rows) == {"lda", "naive_bayes"}
    assert rows["lda"]["fit_seconds"] == first.first()["fit_seconds"]


def test_grid_reports_failed_reductions(blobs):
    df = blobs[0].unionByName(blobs[1])
    plan = [dict(test_size=0.4, method="kpca", kernel="rbf", components=2),
            dict(test_size=0.4, method="nonsense", kernel="rbf", components=2)]
    rows = studies.reduction_grid(df, "label", ["id"], FEATURES, plan, ["naive_bayes"], sample=None).collect()
    status = {r["method"]: r["status"] for r in rows}
    assert status["kpca"] == "ok" and status["nonsense"].startswith("ValueError")
    assert {r["gamma_label"] for r in rows} == {"default"}


def test_models_without_weights_refuse_them(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "b")], "id long, f double, label string")
    with pytest.raises(ValueError):
        models.fit_predict("lda", df, df, "label", ["id"], ["f"], class_weight=True)


def test_missing_values_are_not_the_mean_of_a_leak(spark):
    from flowlab.plans import studies

    rows = [(i, 5.0, "a") for i in range(40)] + [(40, None, "a"), (41, 1.0, "b"), (42, 9.0, "b")] * 1
    df = spark.createDataFrame(rows, "id long, f double, label string")

    def score(train, every):
        return models.fit_predict("naive_bayes", train, every, "label", ["id"], ["f"])

    for seed in range(3):
        segments = studies.leakage_study(df, "label", ["id"], ["f"], score, seed=seed)
        leaked = segments.where("leaked").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        from flowlab.operators import sampling
        parts = sampling.stratified_split(df, "label", ["id"], 0.4, seed)
        assert leaked == parts.where("not is_train and f = 5.0").count()
