"""Linear and quadratic discriminants from per-class sums.

One distributed pass gives rows, sums and products per class; everything after
that happens on p*p matrices. Scoring is a vectorised function of the features."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowlab.tables import numeric_matrix, ref, ship, struct_of, ticks, tree_sum, unpack

# Shrinkage steps tried in order, and the rank tolerance.
SHRINKAGE_LADDER = (0.1, 0.25, 0.5, 0.8, 0.95)
RANK_TOLERANCE = 1e-12


@dataclass
class ClassMoments:
    classes: list
    counts: np.ndarray      # K
    means: np.ndarray       # K x p
    scatters: np.ndarray    # K x p x p, around the class mean

    @property
    def priors(self):
        return self.counts / self.counts.sum()

    @property
    def overall_mean(self):
        return self.priors @ self.means


def class_moments(df, label, features):
    """Rows, mean and scatter matrix per class. Features must not be missing."""
    features = list(features)
    p = len(features)
    shift = np.array([float(v or 0.0) for v in df.selectExpr(*[f"avg({t})" for t in ticks(features)]).first()])

    def sums(pdf):
        x = numeric_matrix(pdf, features) - shift
        codes, names = pd.factorize(pdf["_label"])
        out = {}
        for code, name in enumerate(names):
            part = x[codes == code]
            out[name] = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        return out

    kept = df.select(*ticks(features), ref(label).cast("string").alias("_label")).where(
        "_label is not null")
    totals = tree_sum(kept, [*features, "_label"], sums)
    classes = sorted(totals)
    counts, means, scatters = [], [], []
    for c in classes:
        n, s, q = totals[c][0], totals[c][1:p + 1], totals[c][p + 1:].reshape(p, p)
        counts.append(n)
        means.append(s / n + shift)
        scatters.append(q - np.outer(s, s) / n)
    return ClassMoments(classes, np.array(counts), np.array(means), np.array(scatters))


def _signed(vectors):
    """Columns with their largest entry positive, so signs do not depend on the solver."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


class LinearDiscriminant:
    """Pooled covariance: projection onto the class-separating directions and
    linear class scores. Directions without spread inside the classes are dropped."""

    def __init__(self, moments, tolerance=1e-4):
        m = moments
        k, n = len(m.classes), m.counts.sum()
        within = m.scatters.sum(axis=0)
        spread = np.sqrt(np.maximum(np.diag(within) / n, 0.0))
        spread[spread == 0] = 1.0
        value, vector = np.linalg.eigh(within / np.outer(spread, spread) / max(n - k, 1))
        keep = value > tolerance ** 2
        whiten = (vector[:, keep] / np.sqrt(value[keep])) / spread[:, None]
        offset = m.means - m.overall_mean
        between = (offset @ whiten) * np.sqrt(n * m.priors / max(k - 1, 1))[:, None]
        value, vector = np.linalg.eigh(between.T @ between)
        order = np.argsort(value)[::-1]
        value, vector = value[order], vector[:, order]
        keep = (np.sqrt(np.maximum(value, 0)) > tolerance * np.sqrt(max(value[0], 0)))[:]
        keep[k - 1:] = False
        self.scalings = _signed(whiten @ vector[:, keep])
        self.center = m.overall_mean
        self.classes = m.classes
        axes = offset @ self.scalings
        self.coef = axes @ self.scalings.T
        self.intercept = np.log(m.priors) - 0.5 * (axes ** 2).sum(axis=1) - self.coef @ self.center

    def scores(self, x):
        return x @ self.coef.T + self.intercept

    def project(self, x, k=None):
        return (x - self.center) @ self.scalings[:, :k]


class QuadraticDiscriminant:
    """A covariance per class, pulled towards a sphere by a fixed shrinkage."""

    def __init__(self, moments, shrinkage=0.5, tolerance=1e-4):
        self.classes, self.means, self.priors = moments.classes, moments.means, moments.priors
        self.whiten, self.log_det = [], []
        p = moments.means.shape[1]
        for n, scatter in zip(moments.counts, moments.scatters):
            cov = scatter / n
            cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / p * np.eye(p)
            value, vector = np.linalg.eigh(cov)
            if not (value > tolerance).all():
                raise ValueError("a class covariance is singular")
            self.whiten.append(vector / np.sqrt(value))
            self.log_det.append(np.log(value).sum())

    def scores(self, x):
        out = np.empty((len(x), len(self.classes)))
        for i, (mean, whiten, log_det, prior) in enumerate(
                zip(self.means, self.whiten, self.log_det, self.priors)):
            z = (x - mean) @ whiten
            out[:, i] = -0.5 * ((z * z).sum(axis=1) + log_det) + np.log(prior)
        return out


def fit_on_ladder(moments, ladder=SHRINKAGE_LADDER, tolerance=RANK_TOLERANCE):
    """Quadratic discriminant with the smallest shrinkage that can be estimated.
    Returns (model, shrinkage)."""
    for shrinkage in ladder:
        try:
            return QuadraticDiscriminant(moments, shrinkage, tolerance), shrinkage
        except ValueError:
            continue
    raise ValueError("no shrinkage makes every class covariance invertible")


def predict_class(df, features, model, name="prediction"):
    """Class with the highest score; Arrow batches, nothing is shuffled."""
    features = list(features)
    shipped = ship(df.sparkSession, model)

    @pandas_udf("string")
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fitted = unpack(shipped)
        names = np.array(fitted.classes, dtype=object)
        for batch in batches:
            yield pd.Series(names[fitted.scores(numeric_matrix(batch, features)).argmax(axis=1)])

    return df.withColumn(name, best(struct_of(features)))


def project(df, features, model, k=None, name="projected"):
    """Array column with the model's projection of the features."""
    features = list(features)
    shipped = ship(df.sparkSession, model)

    @pandas_udf("array<double>")
    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fitted = unpack(shipped)
        for batch in batches:
            yield pd.Series(list(fitted.project(numeric_matrix(batch, features), k)))

    return df.withColumn(name, axes(struct_of(features)))


def lda_reduce(train, frames, label, features, k=15, name="projected"):
    """Supervised projection fitted on ``train``: at most one axis fewer than classes."""
    moments = class_moments(train, label, features)
    model = LinearDiscriminant(moments)
    k = min(k, len(moments.classes) - 1)
    return [project(f, features, model, k, name) for f in frames], model
