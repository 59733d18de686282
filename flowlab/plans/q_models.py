"""Classifiers and reductions on the vectors and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import boosting, discriminant, hinge, metrics, models, prep, reduce, sampling
from flowlab.plans import fixtures as X
from flowlab.plans.registry import query
from flowlab.session import materialised


def split_vectors(spark, sf, test_size=0.4):
    """Vector rows with one column per dimension, split into train and test."""
    t, names = X.vector_columns(spark, sf)
    parts = materialised(sampling.stratified_split(t, "label", ["id"], test_size))
    return parts.where("is_train"), parts.where("not is_train"), names


NB = ["quantity", "price", "discount", "tax", "rate"]


def predictions(name, spark, sf):
    """Predictions of one classifier for the test rows of the records."""
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", *NB), "label", ["flow_id"], 0.4))
    return models.fit_predict(name, parts.where("is_train"), parts.where("not is_train"), "label",
                              ["flow_id"], NB).select("flow_id", "label", "prediction")


def nb_sql(source, row_id, features, test_size=0.4, tag="", columns=""):
    """Gaussian naive Bayes in SQL: fill and scale from the training rows, add 1e-9 of
    the largest variance to every variance, pick the class with the largest log
    posterior. Ends in ``{tag}guessed``(row id, label, prediction, columns...)."""
    t = tag
    extra = f", {columns}" if columns else ""

    def each(text, sep=", "):
        return sep.join(text.format(f=f) for f in features)

    return (
        X.split_sql(source, row_id, test_size, name=f"{t}parts"),
        f"{t}fills AS (SELECT {each('avg({f}) AS f_{f}')} FROM {t}parts WHERE is_train)",
        f"{t}filled AS (SELECT {row_id}, label, is_train{extra}, "
        f"{each('coalesce({f}, f_{f}) AS n_{f}')} FROM {t}parts, {t}fills)",
        f"{t}spreads AS (SELECT {each('avg(n_{f}) AS m_{f}, stddev_pop(n_{f}) AS s_{f}')} FROM {t}filled WHERE is_train)",
        f"{t}scaled AS (SELECT {row_id}, label, is_train{extra}, {each('(n_{f} - m_{f}) / s_{f} AS z_{f}')} "
        f"FROM {t}filled, {t}spreads)",
        f"{t}widest AS (SELECT 1e-9 * greatest({each('var_pop(z_{f})')}) AS eps FROM {t}scaled WHERE is_train)",
        f"{t}fitted AS (SELECT label AS class, ln(count(*) / (SELECT count(*) FROM {t}scaled WHERE is_train)) AS prior, "
        f"{each('avg(z_{f}) AS m_{f}, var_pop(z_{f}) + max(eps) AS v_{f}')} "
        f"FROM {t}scaled, {t}widest WHERE is_train GROUP BY label)",
        f"{t}posterior AS (SELECT {row_id}, label{extra}, class, prior "
        f"{each('- 0.5 * ln(2 * pi() * v_{f}) - pow(z_{f} - m_{f}, 2) / (2 * v_{f})', ' ')} AS score "
        f"FROM {t}scaled, {t}fitted WHERE NOT is_train)",
        f"{t}guessed AS (SELECT {row_id}, label{extra}, first(class ORDER BY score DESC, class) AS prediction "
        f"FROM {t}posterior GROUP BY ALL)")


NB_SQL = (X.FLOWS_SQL, *nb_sql("flows", "flow_id", NB))


@query("clf_gaussian_nb", X.with_sql(*NB_SQL, "SELECT flow_id, label, prediction FROM guessed"))
def _(spark, sf):
    return predictions("naive_bayes", spark, sf)


def gaussian_sql(features, pooled, shrinkage=0.0):
    """Normal classes with whole covariances in SQL, after ``scaled``: a Cholesky factor per
    class, column by column, then the distances by forward substitution."""
    p = len(features)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    means = ", ".join(f"m{i}" for i in range(p))

    def cell(i, j):
        if pooled:
            return f"sum(n * c{i}_{j}) OVER () / (sum(n) OVER () - count(*) OVER ())"
        trace = " + ".join(f"c{k}_{k}" for k in range(p))
        return f"{1 - shrinkage} * c{i}_{j}" + (f" + {shrinkage} * ({trace}) / {p}" if i == j else "")

    yield ("moments AS (SELECT label AS class, count(*) AS n, "
           + ", ".join(f"avg(z_{f}) AS m{i}" for i, f in enumerate(features)) + ", "
           + ", ".join(f"covar_pop(z_{features[i]}, z_{features[j]}) AS c{i}_{j}" for i, j in cells)
           + " FROM scaled WHERE is_train GROUP BY label)")
    yield (f"chol AS (SELECT class, n, ln(n / sum(n) OVER ()) AS prior, {means}, "
           + ", ".join(f"{cell(i, j)} AS s{i}_{j}" for i, j in cells) + " FROM moments)")
    last = "chol"
    for j in range(p):
        root = f"s{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        yield f"chol{j}d AS (SELECT *, sqrt({root}) AS l{j}_{j} FROM {last})"
        below = ["(" + f"s{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j} AS l{i}_{j}"
                 for i in range(j + 1, p)]
        yield f"chol{j} AS (SELECT {', '.join(['*', *below])} FROM chol{j}d)"
        last = f"chol{j}"
    yield f"factors AS (SELECT * FROM {last})"


def substitution_sql(source, vector):
    """``solved``: the rows of ``source`` (with a factor each) plus y0, y1, ...: the vector
    without the spread of the class."""
    last = source
    for i, x in enumerate(vector):
        rest = "".join(f" - l{i}_{k} * y{k}" for k in range(i))
        yield f"solve{i} AS (SELECT *, ({x}{rest}) / l{i}_{i} AS y{i} FROM {last})"
        last = f"solve{i}"
    yield f"solved AS (SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(len(vector)))} AS distance FROM {last})"


def gaussian_classes_sql(features, pooled, shrinkage=0.0):
    """Classes of the test rows by the largest log posterior."""
    spread = "" if pooled else " - " + " - ".join(f"ln(l{i}_{i})" for i in range(len(features)))
    return X.with_sql(
        *NB_SQL[:6], *gaussian_sql(features, pooled, shrinkage),
        "paired AS (SELECT * FROM scaled, factors WHERE NOT is_train)",
        *substitution_sql("paired", [f"z_{f} - m{i}" for i, f in enumerate(features)]), f"""
SELECT flow_id, label, first(class ORDER BY prior{spread} - 0.5 * distance DESC, class) AS prediction
FROM solved GROUP BY 1, 2""")


for _key, _model, _sql in (("clf_lda", "lda", gaussian_classes_sql(NB, pooled=True)),
                           ("clf_qda", "qda", gaussian_classes_sql(NB, pooled=False, shrinkage=0.5))):
    @query(_key, _sql)
    def _(spark, sf, model=_model):
        return predictions(model, spark, sf)


# The classes follow a rule over two columns with fewer values than bins, and nothing else
# explains them: a grown tree has to give back that rule for rows it has not seen.
GROWN_TREE_SQL = X.with_sql(X.FLOWS_SQL, X.split_sql("flows", "flow_id", 0.4), """
SELECT flow_id, label, CASE WHEN quantity < 45 THEN 'BENIGN' WHEN quantity >= 50 AND discount >= 0.1 THEN 'RARE'
  ELSE 'MID' END AS prediction FROM parts WHERE NOT is_train""")


@query("clf_decision_tree", GROWN_TREE_SQL)
def _(spark, sf):
    return predictions("decision_tree", spark, sf)


for _key, _model in (("clf_sgd_hinge", "sgd"),
                     ("clf_random_forest", "random_forest"), ("clf_gbt_ovr", "hist_gb"), ("clf_gbt_deep", "xgboost"),
                     ("clf_gbt_leaves", "lightgbm"),
                     ("clf_adaboost", "adaboost"), ("clf_mlp", "mlp"), ("clf_linear_svm", "linear_svm"),
                     ("clf_logistic", "logistic"), ("clf_rbf_svm", "svm")):
    @query(_key)
    def _(spark, sf, model=_model):
        return predictions(model, spark, sf)


# One-against-rest squared hinge on one standardised feature, by Newton steps over a weight and an intercept.
# Rows with equal values and label are one row with a number.
def newton_hinge_sql(steps):
    yield "g AS (SELECT z_quantity AS z, label, CAST(count(*) AS DOUBLE) AS n FROM scaled WHERE is_train GROUP BY ALL)"
    yield ("rows AS (SELECT z, n, class, CASE WHEN label = class THEN 1.0 ELSE -1.0 END AS y FROM g, "
           "(SELECT DISTINCT label AS class FROM g))")
    yield "w0 AS (SELECT DISTINCT class, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b FROM rows)"
    for k in range(steps):
        slack = "greatest(1 - y * (w * z + b), 0)"
        live = f"(CASE WHEN {slack} > 0 THEN n ELSE 0 END)"
        yield (f"m{k} AS (SELECT class, w, b, w - 2 * sum(n * {slack} * y * z) AS gw, b - 2 * sum(n * {slack} * y) AS gb, "
               f"1 + 2 * sum({live} * z * z) AS hw, 2 * sum({live} * z) AS hc, 1 + 2 * sum({live}) AS hb "
               f"FROM rows JOIN w{k} USING (class) GROUP BY class, w, b)")
        yield (f"w{k + 1} AS (SELECT class, w - (hb * gw - hc * gb) / (hw * hb - hc * hc) AS w, "
               f"b - (hw * gb - hc * gw) / (hw * hb - hc * hc) AS b FROM m{k})")


@query("linear_svm_weights", X.with_sql(
    X.FLOWS_SQL, *nb_sql("flows", "flow_id", ["quantity"])[:5], *newton_hinge_sql(20), """
SELECT class, round(w, 5) AS weight, round(b, 5) AS intercept FROM w20"""))
def _(spark, sf):
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", "quantity"), "label", ["flow_id"], 0.4)).where("is_train")
    (train,) = prep.prepare(parts, [parts], ["quantity"])
    classes = models.class_list(train, "label")
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    w, b = hinge.squared_hinge(train, ["quantity"], code, len(classes), 1.0)
    rows = [(c, round(float(x), 5), round(float(y), 5)) for c, x, y in zip(classes, w[:, 0], b)]
    return spark.createDataFrame(rows, "class string, weight double, intercept double")


# Boosted stumps in SQL: two rounds of softmax gradients, curvatures and gains over three columns with
# fewer values than bins. Rows with equal values and label are one row with a number.
STUMP_FEATURES = ["quantity", "discount", "tax"]
STUMP = dict(step=0.3, ridge=1.0, least_curvature=1.0)


def stump_rounds_sql(rounds):
    f = ", ".join(STUMP_FEATURES)
    yield f"g AS (SELECT {f}, label, count(*) AS n FROM parts WHERE is_train GROUP BY ALL)"
    yield "classes AS (SELECT label AS class, ln(sum(n) / sum(sum(n)) OVER ()) AS score FROM g GROUP BY label)"
    yield "s0 AS (SELECT g.*, class, score FROM g, classes)"
    yield f"t0 AS (SELECT DISTINCT {f}, class, score FROM (SELECT DISTINCT {f} FROM parts WHERE NOT is_train), classes)"
    for r in range(1, rounds + 1):
        before = r - 1
        yield (f"p{r} AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS p "
               f"FROM s{before} WINDOW w AS (PARTITION BY {f}, label))")
        yield f"d{r} AS (SELECT *, n * (p - CASE WHEN label = class THEN 1 ELSE 0 END) AS gr, n * p * (1 - p) AS cu FROM p{r})"
        yield f"h{r} AS (" + " UNION ALL ".join(
            f"SELECT class, {i} AS i, '{c}' AS feature, {c} AS v, sum(gr) AS gr, sum(cu) AS cu FROM d{r} GROUP BY class, {c}"
            for i, c in enumerate(STUMP_FEATURES)) + ")"
        yield (f"l{r} AS (SELECT *, sum(gr) OVER u AS gl, sum(cu) OVER u AS cl, sum(gr) OVER a AS ga, sum(cu) OVER a AS ca, "
               f"max(v) OVER a AS top FROM h{r} WINDOW u AS (PARTITION BY class, i ORDER BY v), a AS (PARTITION BY class, i))")
        yield (f"q{r} AS (SELECT class, i, feature, v, gl * gl / (cl + 1) + (ga - gl) * (ga - gl) / (ca - cl + 1) - ga * ga / (ca + 1) AS gain, "
               f"-0.3 * gl / (cl + 1) AS low, -0.3 * (ga - gl) / (ca - cl + 1) AS high FROM l{r} WHERE v < top AND cl >= 1 AND ca - cl >= 1)")
        yield (f"b{r} AS (SELECT * FROM q{r} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY class ORDER BY gain DESC, i, v) = 1)")
        for t in "st":
            pick = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in STUMP_FEATURES) + " END"
            keys = f"{f}, label, n" if t == "s" else f
            yield (f"{t}{r} AS (SELECT {keys}, x.class, score + coalesce(CASE WHEN {pick} <= v THEN low ELSE high END, 0) AS score "
                   f"FROM {t}{before} x LEFT JOIN b{r} b ON x.class = b.class)")


STUMPS_SQL = (X.FLOWS_SQL, X.split_sql("flows", "flow_id", 0.4), *stump_rounds_sql(2))


def _stumps(spark, sf, rounds=2):
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", *STUMP_FEATURES), "label", ["flow_id"], 0.4))
    train = parts.where("is_train")
    growth = boosting.Growth(rounds=rounds, depth=1, **STUMP)
    return boosting.fit(train, STUMP_FEATURES, "label", models.class_list(train, "label"), growth), parts.where("not is_train")


@query("gbt_first_rounds", X.with_sql(*STUMPS_SQL, """
SELECT CAST(1 AS INTEGER) AS round, class, feature, v AS threshold, round(gain, 4) AS gain, round(low, 6) AS left_value, round(high, 6) AS right_value FROM b1
UNION ALL SELECT 2, class, feature, v, round(gain, 4), round(low, 6), round(high, 6) FROM b2"""))
def _(spark, sf):
    table = boosting.tree_table(_stumps(spark, sf)[0], STUMP_FEATURES, spark)
    return table.select("round", "class", "feature", "threshold", F.round("gain", 4).alias("gain"),
                        F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"))


@query("clf_gbt_stumps", X.with_sql(*STUMPS_SQL, f"""
SELECT flow_id, label, first(class ORDER BY score DESC, class) AS prediction
FROM parts JOIN t2 USING ({', '.join(STUMP_FEATURES)}) WHERE NOT is_train GROUP BY 1, 2"""))
def _(spark, sf):
    model, test = _stumps(spark, sf)
    return discriminant.predict_class(test, STUMP_FEATURES, model).select("flow_id", "label", "prediction")


@query("clf_decision_tree_weighted", GROWN_TREE_SQL)
def _(spark, sf):
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", *NB), "label", ["flow_id"], 0.4))
    return models.fit_predict("decision_tree", parts.where("is_train"), parts.where("not is_train"), "label",
                              ["flow_id"], NB, class_weight=True).select(
        "flow_id", "label", "prediction")


@query("qda_shrinkage_ladder", X.with_sql(X.VECTORS_SQL, X.split_sql("vectors", "id", 0.4), """
SELECT label AS class, count(*) AS n, CAST(0.1 AS DOUBLE) AS shrinkage FROM parts WHERE is_train GROUP BY label"""))
def _(spark, sf):
    train, _, names = split_vectors(spark, sf)
    moments = discriminant.class_moments(train, "label", names)
    _, shrinkage = discriminant.fit_on_ladder(moments)
    rows = [(c, int(n), float(shrinkage)) for c, n in zip(moments.classes, moments.counts)]
    return spark.createDataFrame(rows, "class string, n bigint, shrinkage double")


@query("class_moments", X.with_sql(X.FLOWS_SQL, """
SELECT label AS class, count(*) AS n, round(avg(price), 4) AS mean_price, round(covar_pop(price, quantity), 3) AS price_quantity,
  round(var_pop(discount), 8) AS var_discount FROM flows GROUP BY label"""))
def _(spark, sf):
    m = discriminant.class_moments(X.flows(spark, sf), "label", ["price", "quantity", "discount"])
    rows = [(c, int(n), float(mean[0]), float(s[0, 1] / n), float(s[2, 2] / n))
            for c, n, mean, s in zip(m.classes, m.counts, m.means, m.scatters)]
    t = spark.createDataFrame(rows, "class string, n bigint, mean_price double, price_quantity double, var_discount double")
    return t.select("class", "n", F.round("mean_price", 4).alias("mean_price"),
                    F.round("price_quantity", 3).alias("price_quantity"),
                    F.round("var_discount", 8).alias("var_discount"))


def _prepared(spark, sf):
    train, test, names = split_vectors(spark, sf)
    train, test = prep.prepare(train, [train, test], names)
    return train, test, names


def _axes(frame):
    return frame.select("id", "label", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query("pca_project")
def _(spark, sf):
    train, test, names = _prepared(spark, sf)
    (_, out), _ = reduce.pca(train, [train, test], names, 15)
    return _axes(out)


# The variances of all axes of the training rows are the eigenvalues of their correlations C.
# Their power sums are the traces of C, CC, CCC and CCCC, and only if the axes do not correlate.
@query("pca_spectrum", X.with_sql(
    X.VECTORS_SQL, X.split_sql("vectors", "id", 0.4),
    "cells AS (SELECT id, unnest(range(len(vector))) AS i, CAST(unnest(vector) AS DOUBLE) AS x FROM parts WHERE is_train)",
    "c AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM cells a JOIN cells b USING (id) GROUP BY 1, 2)",
    "cc AS (SELECT a.i, b.j, sum(a.r * b.r) AS r FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)", """
SELECT 1 AS power, round(sum(r), 4) AS total FROM c WHERE i = j
UNION ALL SELECT 2, round(sum(r * r), 4) FROM c
UNION ALL SELECT 3, round(sum(c.r * cc.r), 4) FROM c JOIN cc USING (i, j)
UNION ALL SELECT 4, round(sum(r * r), 4) FROM cc"""))
def _(spark, sf):
    train, _, names = _prepared(spark, sf)
    (out,), _ = reduce.pca(train, [train], names, len(names))
    axes = out.select(F.posexplode("projected").alias("axis", "z")).groupBy("axis").agg(F.var_pop("z").alias("v"))
    return axes.select(F.inline(F.array(*[F.struct(F.lit(p).alias("power"), F.pow("v", F.lit(p)).alias("v"))
                                          for p in (1, 2, 3, 4)]))).groupBy("power").agg(
        F.round(F.sum("v"), 4).alias("total"))


# Squared distances between projected class means and the projected mean of all rows are
# distances under the pooled covariance, whatever the rotation of the axes.
@query("lda_class_distances", X.with_sql(
    *NB_SQL[:6], *gaussian_sql(NB, pooled=True),
    *substitution_sql("factors", [f"m{i}" for i in range(len(NB))]), """
SELECT class, n, round(distance, 6) AS distance FROM solved"""))
def _(spark, sf):
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", *NB), "label", ["flow_id"], 0.4)).where("is_train")
    (train,) = prep.prepare(parts, [parts], NB)
    (out,), _ = discriminant.lda_reduce(train, [train], "label", NB, 15)
    means = out.select("label", F.posexplode("projected").alias("axis", "z")).groupBy("label", "axis").agg(
        F.avg("z").alias("m"), F.count("z").alias("n"))
    return means.groupBy(F.col("label").alias("class")).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("m") * F.col("m")), 6).alias("distance"))


@query("lda_project")
def _(spark, sf):
    train, test, names = _prepared(spark, sf)
    (_, out), _ = discriminant.lda_reduce(train, [train, test], "label", names, 15)
    return _axes(out)


for _kernel in reduce.KERNELS:
    @query("kpca_project" if _kernel == "rbf" else f"kpca_project_{_kernel}")
    def _(spark, sf, kernel=_kernel):
        train, test, names = _prepared(spark, sf)
        (_, out), _ = reduce.kernel_pca(train, [train, test], "label", ["id"], names, kernel, 15)
        return _axes(out)


@query("clf_summary_logistic")
def _(spark, sf):
    return metrics.classification_summary(metrics.confusion_counts(predictions("logistic", spark, sf)))


# With full shrinkage every class covariance is a sphere, which SQL can score.
@query("clf_qda_spherical", X.with_sql(*NB_SQL[:6], """sphere AS (
  SELECT label AS class, ln(count(*) / (SELECT count(*) FROM scaled WHERE is_train)) AS prior, """ + ", ".join(
    f"avg(z_{f}) AS m_{f}" for f in NB) + ", (" + " + ".join(f"var_pop(z_{f})" for f in NB) + f") / {len(NB)} AS v"
    + " FROM scaled WHERE is_train GROUP BY label)", "votes AS (SELECT flow_id, label, class, prior - 0.5 * ("
    + f"{len(NB)} * ln(v) + (" + " + ".join(f"pow(z_{f} - m_{f}, 2)" for f in NB) + """) / v) AS score
  FROM scaled, sphere WHERE NOT is_train)""", """
SELECT flow_id, label, first(class ORDER BY score DESC, class) AS prediction FROM votes GROUP BY 1, 2"""))
def _(spark, sf):
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", *NB), "label", ["flow_id"], 0.4))
    return models.fit_predict("qda", parts.where("is_train"), parts.where("not is_train"), "label", ["flow_id"],
                              NB, shrinkage=1.0).select("flow_id", "label", "prediction")


# With a single feature the pooled covariance is one number.
@query("clf_lda_single", X.with_sql(X.FLOWS_SQL, *nb_sql("flows", "flow_id", ["quantity"])[:5], """means AS (
  SELECT label AS class, count(*) AS n, avg(z_quantity) AS m, var_pop(z_quantity) * count(*) AS scatter
  FROM scaled WHERE is_train GROUP BY label)""", """pooled AS (SELECT sum(scatter) / (sum(n) - count(*)) AS v, sum(n) AS total FROM means)""",
    """votes AS (SELECT flow_id, label, class, ln(n / total) - pow(z_quantity - m, 2) / (2 * v) AS score
  FROM scaled, means, pooled WHERE NOT is_train)""", """
SELECT flow_id, label, first(class ORDER BY score DESC, class) AS prediction FROM votes GROUP BY 1, 2"""))
def _(spark, sf):
    parts = materialised(sampling.stratified_split(
        X.flows(spark, sf).select("flow_id", "label", "quantity"), "label", ["flow_id"], 0.4))
    return models.fit_predict("lda", parts.where("is_train"), parts.where("not is_train"), "label", ["flow_id"],
                              ["quantity"]).select("flow_id", "label", "prediction")


# All axes together keep the length of a row: its squared distance from the training mean.
NORMS_SQL = X.with_sql(
    X.VECTORS_SQL, X.split_sql("vectors", "id", 0.4),
    "cells AS (SELECT id, is_train, unnest(range(len(vector))) AS i, CAST(unnest(vector) AS DOUBLE) AS x FROM parts)",
    "stats AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM cells WHERE is_train GROUP BY i)", """
SELECT id, round(sum(pow((x - m) / s, 2)), 6) AS norm FROM cells JOIN stats USING (i) WHERE NOT is_train GROUP BY id""")


def _norms(frame):
    return frame.select("id", F.round(F.aggregate(
        "projected", F.lit(0.0), lambda total, z: total + z * z), 6).alias("norm"))


@query("pca_norms", NORMS_SQL)
def _(spark, sf):
    train, test, names = _prepared(spark, sf)
    (out,), _ = reduce.pca(train, [test], names, len(names))
    return _norms(out)


@query("kpca_linear_norms", NORMS_SQL)
def _(spark, sf):
    train, test, names = _prepared(spark, sf)
    (out,), _ = reduce.kernel_pca(train, [test], "label", ["id"], names, "linear", len(names))
    return _norms(out)
