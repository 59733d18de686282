"""Classifier registry. Every fit is a Spark job; no training rows are collected
beyond the landmark samples of the kernel methods."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.sql import functions as F

from flowlab.operators import boosting, discriminant, forest, hinge, network
from flowlab.operators.neighbors import knn_join, knn_vote
from flowlab.operators.prep import label_codes, prepare, vector_of, with_class_weight
from flowlab.operators.reduce import KernelMap, landmark_rows
from flowlab.session import dropped, materialised
from flowlab.tables import is_few, ref, settled, spread, tick, ticks, tree_sum


@dataclass
class Spec:
    """scaled: standardise first; heavy: cost grows faster than the rows; weighted: rows can
    have weights; sweep: part of a full comparison (neither heavy nor dear for what it gives)."""
    fit: object
    scaled: bool = True
    heavy: bool = False
    weighted: bool = True
    sweep: bool = True
    options: dict = field(default_factory=dict)


@dataclass
class Task:
    """What a classifier gets to see."""
    train: object
    test: object
    features: list
    label: str
    ids: list
    classes: list
    weight: str = None


def _code(task):
    return (F.array_position(F.array(*[F.lit(c) for c in task.classes]), ref(task.label)) - 1).cast("double")


def _coded(df, task):
    return vector_of(df.withColumn("_code", _code(task)), task.features, "_features")


def _named(df, task):
    names = F.array(*[F.lit(c) for c in task.classes])
    code = (F.col("_prediction") + 1).cast("int")
    drop = [c for c in df.columns if c.startswith("_")]
    return df.withColumn("prediction", F.element_at(names, code)).drop(*drop)


def _spark_ml(make):
    """Fit a Spark ML estimator made by ``make(task, options)``."""
    def fit(task, options):
        train = spread(_coded(task.train, task).select("_features", "_code", *[task.weight] * bool(task.weight))).persist()
        try:
            model = make(task, options).fit(train)
        finally:
            train.unpersist()
        return _named(model.transform(_coded(spread(task.test), task)), task)
    return fit


COLUMNS = dict(featuresCol="_features", labelCol="_code", predictionCol="_prediction")


def _with_weight(task, settings):
    if task.weight:
        settings["weightCol"] = task.weight
    return settings


@dataclass
class GaussianScores:
    """Log posteriors of independent normal features per class."""
    classes: list
    priors: np.ndarray      # K
    means: np.ndarray       # K x p
    variances: np.ndarray   # K x p

    def scores(self, x):
        out = np.empty((len(x), len(self.classes)))
        for i, (prior, mean, variance) in enumerate(zip(self.priors, self.means, self.variances)):
            out[:, i] = (np.log(prior) - 0.5 * np.log(2 * np.pi * variance).sum()
                         - ((x - mean) ** 2 / (2 * variance)).sum(axis=1))
        return out


def _naive_bayes(task, options):
    """One aggregate gives everything: K x p means and variances. Weights are equal within a
    class, so they only move the priors. Every variance grows by a share of the widest one."""
    cells = [f"struct(avg({t}) AS mean, var_pop({t}) AS spread)" for t in ticks(task.features)]
    size = f"sum({tick(task.weight)})" if task.weight else "cast(count(1) AS double)"
    rows = (task.train.where(ref(task.label).isNotNull()).groupBy(ref(task.label).alias("class"))
            .agg(F.expr(size).alias("size"), F.expr(f"array({', '.join(cells)})").alias("cells"))
            .orderBy("class").collect())
    widest = task.train.selectExpr(f"greatest(0D, {', '.join(f'var_pop({t})' for t in ticks(task.features))})").first()[0]
    sizes = np.array([r["size"] for r in rows])
    model = GaussianScores([r["class"] for r in rows], sizes / sizes.sum(),
                           np.array([[c["mean"] for c in r["cells"]] for r in rows]),
                           np.array([[c["spread"] for c in r["cells"]] for r in rows]) + options["smoothing"] * widest)
    return discriminant.predict_class(task.test, task.features, model)


def _tree(task, options):
    return C.DecisionTreeClassifier(
        impurity="entropy", maxDepth=options["max_depth"], maxBins=options["max_bins"],
        seed=options["seed"], rawPredictionCol="_raw", probabilityCol="_p",
        **_with_weight(task, dict(COLUMNS)))


def _grown(task, options):
    return forest.fit(task.train, task.features, task.label, task.classes, options["trees"], options["max_depth"],
                      options["max_bins"], task.weight, options["seed"])


def _forest(task, options):
    return discriminant.predict_class(task.test, task.features, _grown(task, options))


def _boosted(task, options):
    names = ("rounds", "step", "ridge", "least_curvature", "policy", "leaves")
    growth = boosting.Growth(depth=options["max_depth"], **{n: options[n] for n in names if n in options})
    model = boosting.fit(task.train, task.features, task.label, task.classes, growth, options["max_bins"], task.weight)
    return discriminant.predict_class(task.test, task.features, model)


def _logistic(task, options):
    return C.LogisticRegression(
        family="multinomial", maxIter=options["max_iter"], regParam=options["reg"], tol=options["tol"],
        standardization=False, rawPredictionCol="_raw", probabilityCol="_p",
        **_with_weight(task, dict(COLUMNS)))


class LinearScores:
    """Class scores from one weight vector per class, on mapped features if there is a map."""

    def __init__(self, classes, coefficients, intercepts, mapping=None):
        self.classes, self.mapping = classes, mapping
        self.coefficients, self.intercepts = coefficients, intercepts

    def scores(self, x):
        if self.mapping is None:
            return x @ self.coefficients.T + self.intercepts
        return self.mapping.linear(x, self.coefficients) + self.intercepts


def _linear(task, fitted, mapping=None):
    return discriminant.predict_class(task.test, task.features, LinearScores(task.classes, *fitted, mapping))


def _hinge(task, options):
    return _linear(task, hinge.averaged_descent(
        task.train, task.features, _code(task), len(task.classes), options["alpha"], options["max_iter"], options["tol"], task.weight))


def _linear_svm(task, options):
    return _linear(task, hinge.squared_hinge(
        task.train, task.features, _code(task), len(task.classes), options["c"], options["max_iter"], options["tol"], task.weight))


def _network(task, options):
    model = network.fit(task.train, task.features, _code(task), task.ids, task.classes, options["hidden"], options["max_iter"],
                        options["tol"], options["patience"], seed=options["seed"])
    return discriminant.predict_class(task.test, task.features, model)


def _lda(task, options):
    model = discriminant.LinearDiscriminant(
        discriminant.class_moments(task.train, task.label, task.features))
    return discriminant.predict_class(task.test, task.features, model)


def _qda(task, options):
    moments = discriminant.class_moments(task.train, task.label, task.features)
    if options["shrinkage"] is None:
        model, _ = discriminant.fit_on_ladder(moments)
    else:
        model = discriminant.QuadraticDiscriminant(moments, options["shrinkage"])
    return discriminant.predict_class(task.test, task.features, model)


def _knn(task, options):
    vector = F.expr("array(" + ", ".join(ticks(task.features)) + ")")
    row = F.concat_ws(":", *[ref(c).cast("string") for c in task.ids])
    near = knn_join(task.test.select(row.alias("id"), vector.alias("vector")),
                    task.train.select(row.alias("id"), vector.alias("vector"), ref(task.label).alias("label")),
                    options["k"], carry="label")
    votes = knn_vote(near).withColumnRenamed("query", "_query")
    return task.test.join(votes, row == F.col("_query")).drop("_query")


def _rbf_svm(task, options):
    marks = landmark_rows(task.train, task.label, task.ids, task.features, options["landmarks"])
    gamma = options["gamma"]
    if gamma is None:
        spread = marks.var()
        gamma = 1.0 / (len(task.features) * spread) if spread > 0 else 1.0
    mapping = KernelMap(marks, "rbf", gamma)
    alpha = 1.0 / (options["c"] * task.train.count())
    return _linear(task, hinge.averaged_descent(
        task.train, task.features, _code(task), len(task.classes), alpha, options["max_iter"], options["tol"], task.weight,
        mapping=mapping), mapping)


class StumpVotes:
    """Votes of boosted stumps, added up per feature, value range and class."""

    def __init__(self, classes, edges):
        self.classes, self.edges = classes, edges
        self.votes = [np.zeros((len(e) + 1, len(classes))) for e in edges]
        self.losses = [np.zeros((len(e) + 1, len(classes))) for e in edges]

    def add(self, feature, cut, yes, no, alpha):
        """A stump: class ``yes`` up to range ``cut`` of a feature, ``no`` beyond."""
        guess = np.where(np.arange(len(self.edges[feature]) + 1) <= cut, yes, no)
        hit = guess[:, None] == np.arange(len(self.classes))
        self.votes[feature] += alpha * hit
        self.losses[feature] += alpha * ~hit

    def ranges(self, x):
        return [np.searchsorted(edge, x[:, i]) for i, edge in enumerate(self.edges)]

    def scores(self, x):
        return sum(votes[r] for votes, r in zip(self.votes, self.ranges(x)))

    def histograms(self, ranges, codes, shift, counts=1):
        """Weights per feature, range and class of rows that each stand for ``counts`` rows. A row's
        weight follows from the stumps so far by one lookup per feature, whatever their number."""
        weight = counts * np.exp(sum(losses[r, codes] for losses, r in zip(self.losses, ranges)) - shift)
        k = len(self.classes)
        return [np.bincount(r * k + codes, weight, minlength=len(table) * k)
                for r, table in zip(ranges, self.votes)]


def _best_stump(histograms, k):
    """(feature, cut, class up to it, class beyond, error, total) with the least Gini
    impurity; on ties the first feature and the lowest cut."""
    best = None
    for feature, flat in enumerate(histograms):
        left = np.asarray(flat).reshape(-1, k).cumsum(axis=0)
        right = left[-1] - left
        sides = [np.maximum(side.sum(axis=1), 1e-300) for side in (left, right)]
        purity = (left ** 2).sum(axis=1) / sides[0] + (right ** 2).sum(axis=1) / sides[1]
        cut = int(purity.argmax())
        if best is None or purity[cut] > best[0] * (1 + 1e-12):
            yes = int(left[cut].argmax())
            no = int(right[cut].argmax()) if right[cut].sum() > 0 else yes
            total = left[-1].sum()
            best = purity[cut], (feature, cut, yes, no, 1 - (left[cut, yes] + right[cut, no]) / total, total)
    return best[1]


def _adaboost(task, options):
    """Boosted stumps, multi-class exponential loss: a row's weight grows by the weight of
    every stump that got it wrong. Values are cut into ranges once; rows that have all ranges and
    the class in common always weigh the same and are kept as one row with their number in a table
    in the shared folder. A round is one pass over it that adds up weights per feature, range and
    class, so no lineage grows and no state is kept with the rows."""
    k, p = len(task.classes), len(task.features)
    steps = [i / options["max_bins"] for i in range(1, options["max_bins"])]
    quantiles = task.train.approxQuantile(list(task.features), steps, 0.1 / options["max_bins"])
    model = StumpVotes(task.classes, [np.unique(q) for q in quantiles])
    names = [f"r{i}" for i in range(p)]

    def cut(batches):
        for pdf in batches:
            ranges = model.ranges(pdf.iloc[:, :p].to_numpy(dtype=np.float64))
            yield pd.DataFrame({**dict(zip(names, ranges)), "code": pdf["_code"]}).astype("int32")

    columns = [*ticks(task.features), "_code"]
    cut_rows = spread(task.train.withColumn("_code", _code(task).cast("int")).where("_code >= 0").select(*columns)).mapInPandas(
        cut, ", ".join(f"{n} int" for n in [*names, "code"]))
    rows = materialised(cut_rows.groupBy(*names, "code").agg(F.count(F.lit(1)).alias("n")))
    shift, n_rows, few = 0.0, None, is_few(rows)
    for _ in range(options["rounds"]):
        def sums(pdf, shift=shift):
            values = pdf.to_numpy(dtype=np.int64)
            found = model.histograms(list(values[:, :p].T), values[:, p], shift, values[:, p + 1])
            return {str(i): flat for i, flat in enumerate(found)}

        totals = tree_sum(rows, [*names, "code", "n"], sums, few)
        feature, at, yes, no, error, total = _best_stump([totals[str(i)] for i in range(p)], k)
        n_rows = total if n_rows is None else n_rows
        shift += float(np.log(total / n_rows))
        if error <= 1e-15:
            model.add(feature, at, yes, no, 1.0)
            break
        if error >= 1.0 - 1.0 / k:
            break
        model.add(feature, at, yes, no, float(np.log((1 - error) / error) + np.log(k - 1)))
    dropped(rows)
    if not any(votes.any() for votes in model.votes):
        raise ValueError("no stump beats guessing")
    return discriminant.predict_class(task.test, task.features, model)


# The names and settings below are fixed values: results are compared under them.
# Boosting presets: rounds, depth and step size the four boosted variants start from, and how each grows.
_BOOST = dict(max_bins=64)
REGISTRY = {
    "naive_bayes": Spec(_naive_bayes, options=dict(smoothing=1e-9)),
    "lda": Spec(_lda, weighted=False),
    "qda": Spec(_qda, weighted=False, options=dict(shrinkage=0.5)),
    "sgd": Spec(_hinge, options=dict(alpha=1e-4, max_iter=1000, tol=1e-3)),
    "decision_tree": Spec(_spark_ml(_tree), scaled=False,
                          options=dict(max_depth=30, max_bins=64, seed=0)),
    "lightgbm": Spec(_boosted, scaled=False, options=dict(
        _BOOST, rounds=100, max_depth=5, step=0.1, policy="leaves", leaves=31, ridge=0.0, least_curvature=1e-3)),
    "xgboost": Spec(_boosted, scaled=False, options=dict(
        _BOOST, rounds=100, max_depth=6, step=0.3, policy="levels", ridge=1.0, least_curvature=1.0)),
    "random_forest": Spec(_forest, scaled=False,
                          options=dict(trees=100, max_depth=30, max_bins=64, seed=0)),
    "hist_gb": Spec(_boosted, scaled=False, options=dict(
        _BOOST, rounds=100, max_depth=5, step=0.1, policy="leaves", leaves=31, ridge=0.0, least_curvature=1e-3)),
    "catboost": Spec(_boosted, scaled=False, options=dict(
        _BOOST, rounds=300, max_depth=6, step=0.1, policy="symmetric", ridge=3.0, least_curvature=0.0)),
    "adaboost": Spec(_adaboost, scaled=False, weighted=False, sweep=False,
                     options=dict(rounds=100, max_bins=64)),
    "mlp": Spec(_network, weighted=False, options=dict(hidden=[64, 32], max_iter=60, tol=1e-4, patience=10, seed=42)),
    "linear_svm": Spec(_linear_svm, sweep=False, options=dict(c=1.0, max_iter=2000, tol=1e-6)),
    "logistic": Spec(_spark_ml(_logistic), options=dict(max_iter=1000, reg=1e-6, tol=1e-4)),
    "knn": Spec(_knn, heavy=True, sweep=False, weighted=False, options=dict(k=5)),
    "svm": Spec(_rbf_svm, heavy=True, sweep=False, options=dict(c=1.0, gamma=None, landmarks=1000, max_iter=100, tol=1e-3)),
}

# Models of a full sweep.
SWEEP = [n for n, s in REGISTRY.items() if s.sweep]


def class_list(df, label):
    return [r["label"] for r in settled(label_codes(df, label)).orderBy("code").collect()]


@dataclass
class Fitted:
    """A fitted tree model that can score any frame with the same features."""
    model: object
    task: Task

    @property
    def forest(self):
        return self.model if isinstance(self.model, forest.Forest) else None

    def predict(self, df):
        if self.forest is not None:
            return discriminant.predict_class(df, self.task.features, self.model)
        return _named(self.model.transform(vector_of(df, self.task.features, "_features")), self.task)

    def importances(self, features):
        found = self.model.importances() if isinstance(self.model, forest.Forest) else self.model.featureImportances.toArray()
        return [float(v) for v in found][:len(features)]


def fit_model(name, train, label, ids, features, classes=None, **options):
    """Fit a tree model on prepared rows and keep it, for repeated scoring."""
    task = Task(train, None, list(features), label, list(ids), classes or class_list(train, label))
    options = {**REGISTRY[name].options, **options}
    if name == "random_forest":
        return Fitted(_grown(task, options), task)
    if name != "decision_tree":
        raise KeyError(name)
    rows = spread(_coded(train, task)).persist()
    try:
        return Fitted(_tree(task, options).fit(rows), task)
    finally:
        rows.unpersist()


def fit_predict(name, train, test, label, ids, features, classes=None, class_weight=False,
                prepared=False, **options):
    """Test rows with a ``prediction`` column.

    Missing values and scales are learned on the training rows only. Class weights are
    refused by models that cannot use them."""
    spec = REGISTRY[name]
    if class_weight and not spec.weighted:
        raise ValueError(f"{name} takes no class weights")
    features = list(features)
    if not prepared:
        train, test = prepare(train, [train, test], features, spec.scaled)
    classes = classes or class_list(train, label)
    weight = None
    if class_weight:
        train, weight = with_class_weight(train, label, "class_weight"), "class_weight"
    task = Task(train, test, features, label, list(ids), classes, weight)
    return spec.fit(task, {**spec.options, **options})
