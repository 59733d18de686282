"""Linear and kernel principal components, kernel values, kernel feature maps."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowlab.operators.sampling import stratified_sample
from flowlab.tables import numeric_matrix, ref, ship, struct_of, ticks, unpack

KERNELS = ("linear", "poly", "rbf", "sigmoid", "cosine")
# Kernel methods are fitted on a stratified sample of about this many training rows, of which
# they hold a square matrix; all rows are projected.
LANDMARKS = 2_000
# A kernel table has one column of values per landmark row, of at most this many.
MAX_LANDMARKS = 10_000
# Rows per kernel block while projecting.
BLOCK = 2_048
# Rows whose kernel values a feature map holds at a time.
MAPPED = 128
# Values a step apart in the table of powers of e, steps in it (beyond, powers are 0), and a number
# so large that adding it rounds to whole numbers, which are then its lowest bits.
STEP, REACH, WHOLE = 1.0 / 1024, 1 << 20, 2.0 ** 52


def kernel_values(kernel, a, b, gamma=None, degree=3, coef0=1.0):
    """Kernel of every row of ``a`` with every row of ``b``. gamma defaults to 1/p."""
    gamma = 1.0 / a.shape[1] if gamma is None else gamma
    if kernel == "rbf":
        gap, dot = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :], a @ b.T
        gap -= np.multiply(dot, 2.0, out=dot)
        np.maximum(gap, 0.0, out=gap)
        gap *= -gamma
        return np.exp(gap, out=gap)
    dot = a @ b.T
    if kernel == "linear":
        return dot
    if kernel == "poly":
        return (gamma * dot + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if kernel == "cosine":
        lengths = np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
        return np.divide(dot, lengths, out=np.zeros_like(dot), where=lengths > 0)
    raise ValueError(f"unknown kernel: {kernel}")


def kernel_block(df, landmarks, kernel, vector="vector", row_id="id", gamma=None):
    """row, landmark, value for every row and every landmark row.

    The landmarks are a sample of checked size; they travel to the rows."""
    marks = landmarks.select(ref(row_id).alias("landmark"), ref(vector).alias("v")).limit(
        MAX_LANDMARKS + 1).toPandas()
    if len(marks) > MAX_LANDMARKS:
        raise ValueError("too many landmark rows")
    matrix = np.stack(marks["v"].to_numpy()).astype(np.float64)
    shipped = df.sparkSession.sparkContext.broadcast((marks["landmark"].to_numpy(), matrix))

    def scan(batches):
        ids, base = shipped.value
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at:at + BLOCK]
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                value = kernel_values(kernel, x, base, gamma)
                yield pd.DataFrame({"row": np.repeat(part["row"].to_numpy(), len(ids)),
                                    "landmark": np.tile(ids, len(part)), "value": value.ravel()})

    id_type = dict(df.dtypes)[row_id]
    return df.select(ref(row_id).alias("row"), ref(vector).alias("vector")).mapInPandas(
        scan, f"row {id_type}, landmark {id_type}, value double")


def _signed(vectors):
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def top_eigenpairs(matrix, k):
    """Largest algebraic eigenpairs of a symmetric matrix of landmark rows."""
    value, vector = np.linalg.eigh(matrix)
    return value[::-1][:k], vector[:, ::-1][:, :k]


class KernelComponents:
    """Centred kernel principal components over landmark rows. Only directions with
    a positive eigenvalue are kept (the sigmoid kernel also has negative ones)."""

    def __init__(self, landmarks, kernel, k, gamma=None):
        gamma = 1.0 / landmarks.shape[1] if gamma is None else gamma
        self.landmarks, self.kernel, self.gamma = landmarks, kernel, gamma
        gram = kernel_values(kernel, landmarks, landmarks, gamma)
        self.column_mean = gram.mean(axis=0)
        self.grand_mean = gram.mean()
        centred = gram - self.column_mean - self.column_mean[:, None] + self.grand_mean
        value, vector = top_eigenpairs(centred, k)
        keep = value > 1e-12 * max(abs(value[0]), 1e-300)
        self.eigenvalues = value[keep]
        self.weights = _signed(vector[:, keep]) / np.sqrt(value[keep])

    def project(self, x, k=None):
        gram = kernel_values(self.kernel, x, self.landmarks, self.gamma)
        centred = gram - gram.mean(axis=1)[:, None] - self.column_mean + self.grand_mean
        return centred @ self.weights[:, :k]


class KernelMap:
    """Kernel feature map: inner products of mapped rows approximate the kernel, and
    equal it on the landmark rows."""

    def __init__(self, landmarks, kernel, gamma=None):
        self.landmarks, self.kernel = landmarks, kernel
        self.gamma = 1.0 / landmarks.shape[1] if gamma is None else gamma
        value, vector = np.linalg.eigh(kernel_values(kernel, landmarks, landmarks, self.gamma))
        keep = value > 1e-10 * value.max()
        self.weights = vector[:, keep] / np.sqrt(value[keep])
        self.powers = None

    def values(self, x, out=None):
        """Kernel values with the landmark rows, in ``out`` if it is given."""
        out = np.empty((len(x), len(self.landmarks))) if out is None else out
        if self.kernel == "rbf":
            for a in range(0, len(x), MAPPED):
                self._rbf(x[a: a + MAPPED], out[a: a + MAPPED])
        else:
            out[:] = kernel_values(self.kernel, x, self.landmarks, self.gamma)
        return out

    def _rbf(self, x, out):
        """A product gives gamma times the squared distances in steps of the table; the power of the next whole step
        comes from the table, that of the rest, at most half a step, from three terms of its series."""
        if self.powers is None:
            self.powers, marks = np.exp(-STEP * np.arange(REACH)), self.landmarks * (self.gamma / STEP)
            self.side = np.concatenate([-2.0 * marks.T, np.full((1, len(marks)), self.gamma / STEP), (marks * self.landmarks).sum(1)[None]])
            self.rest, self.whole = np.empty((MAPPED, len(marks))), np.empty((MAPPED, len(marks)), np.int64)
        rest, whole = self.rest[:len(x)], self.whole[:len(x)]
        np.matmul(np.concatenate([x, (x * x).sum(1)[:, None], np.ones((len(x), 1))], axis=1), self.side, out=out)
        np.add(out, WHOLE, out=rest)
        np.subtract(rest.view(np.int64), np.float64(WHOLE).view(np.int64), out=whole)
        rest -= WHOLE
        rest -= out
        np.take(self.powers, whole, out=out, mode="clip")
        series = np.multiply(rest, STEP ** 3 / 6, out=whole.view(np.float64))
        for factor in (STEP ** 2 / 2, STEP):
            series += factor
            series *= rest
        series *= out
        out += series

    def project(self, x, k=None):
        return self.values(x) @ self.weights[:, :k]

    def linear(self, x, coefficients):
        """Products of the mapped rows with weight vectors (rows of ``coefficients``), without mapping them, in
        blocks of rows whose kernel values stay in the processor's cache."""
        folded, out = coefficients @ self.weights.T, np.empty((len(x), len(coefficients)))
        for a in range(0, len(x), MAPPED):
            out[a: a + MAPPED] = (folded @ self.values(x[a: a + MAPPED]).T).T
        return out


def landmark_rows(train, label, ids, features, most=LANDMARKS, seed=0):
    """Matrix of a stratified sample of about ``most`` training rows, or of all if there are no
    more. The size is checked before anything reaches the driver."""
    chosen = stratified_sample(train, label, ids, n=most, floor=1, seed=f"landmark{seed}")
    rows = chosen.select(*ticks(features)).limit(2 * most + 1).toPandas()
    if len(rows) > 2 * most:
        raise ValueError("more classes than landmark rows; raise the landmark limit")
    matrix = numeric_matrix(rows, list(features))
    return matrix[np.lexsort(matrix.T[::-1])]


def apply_blocks(df, features, model, k=None, name="projected"):
    """Project all rows in blocks; the fitted model travels to the rows."""
    features = list(features)
    shipped = ship(df.sparkSession, model)

    @pandas_udf("array<double>")
    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fitted = unpack(shipped)
        for batch in batches:
            x = numeric_matrix(batch, features)
            parts = [fitted.project(x[i:i + BLOCK], k) for i in range(0, len(x), BLOCK)]
            yield pd.Series([row for part in parts for row in part])

    return df.withColumn(name, axes(struct_of(features)))


def kernel_pca(train, frames, label, ids, features, kernel="rbf", k=15, gamma=None,
               most=LANDMARKS, name="projected"):
    """Kernel components fitted on a sample of about ``most`` training rows, applied to several frames."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel: {kernel}")
    model = KernelComponents(landmark_rows(train, label, ids, features, most), kernel, k, gamma)
    return [apply_blocks(f, features, model, k, name) for f in frames], model


def pca(train, frames, features, k=15, name="projected"):
    """Principal components fitted on the (standardised, so centred) training rows,
    each axis signed so that its largest weight is positive."""
    from pyspark.ml.feature import PCA, ElementwiseProduct, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    k = min(k, len(features))
    assemble = VectorAssembler(inputCols=list(features), outputCol="_x")
    model = PCA(k=k, inputCol="_x", outputCol="_z").fit(assemble.transform(train))
    axes = model.pc.toArray()
    top = np.abs(axes).argmax(axis=0)
    signs = np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    flip = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_z", outputCol="_s")
    out = [flip.transform(model.transform(assemble.transform(f)))
           .withColumn(name, vector_to_array("_s")).drop("_x", "_z", "_s") for f in frames]
    return out, model


def spread_axes(df, column="projected", k=None, prefix="z"):
    """Array column to one double column per axis."""
    names = [f"{prefix}{i + 1}" for i in range(k)]
    axes = [f"get({column}, {i}) AS {n}" for i, n in enumerate(names)]
    return df.selectExpr("*", *axes), names
