"""Which features separate, repeat or carry a class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.operators.audit import identical_pairs
from flowlab.operators.quantiles import group_medians, pair_rank_sums
from flowlab.operators.sampling import undersample
from flowlab.tables import local_table, numeric_matrix, ref, spread, ticks, tree_sum


def group_median_table(df, label, features, base):
    """Median per feature for the base class and for everything else."""
    side = F.when(ref(label) == F.lit(base), F.lit("base")).otherwise(F.lit("other"))
    return group_medians(df.withColumn("_side", side), features, "_side")


def correlation_pairs(df, features, threshold=0.99):
    """Feature pairs with |Pearson r| at or above ``threshold``, each over the rows
    where both are present, and whether the pair is identical in every row.

    One pass sums p*p matrices per task (values around the feature means, so large
    offsets do not cancel digits); the pair table is p*(p-1)/2 rows."""
    features = list(features)
    p = len(features)
    means = df.selectExpr(*[f"avg({t})" for t in ticks(features)]).first()
    shift = np.array([0.0 if m is None else float(m) for m in means])

    def sums(pdf):
        x = numeric_matrix(pdf, features) - shift
        there = ~np.isnan(x)
        x = np.where(there, x, 0.0)
        m = there.astype(np.float64)
        return {"sums": np.concatenate([
            (m.T @ m).ravel(), (x.T @ m).ravel(), ((x * x).T @ m).ravel(), (x.T @ x).ravel()])}

    total = tree_sum(df, features, sums)["sums"].reshape(4, p, p)
    n, sx, sxx, sxy = total
    with np.errstate(divide="ignore", invalid="ignore"):
        covariance = sxy - sx * sx.T / n
        spread = (sxx - sx * sx / n) * (sxx.T - sx.T * sx.T / n)
        r = np.abs(covariance / np.sqrt(spread))
    floor = 1e-24 * np.maximum(sxx, 1e-300) * np.maximum(sxx.T, 1e-300)
    r = np.where(spread > floor, np.minimum(r, 1.0), np.nan)
    pairs = [(features[i], features[j], float(r[i, j]))
             for i in range(p) for j in range(i + 1, p) if r[i, j] >= threshold]
    spark = df.sparkSession
    table = local_table(spark, pairs, "feature_a string, feature_b string, abs_corr double")
    same = identical_pairs(df, [(a, b) for a, b, _ in pairs])
    return (table.join(same, ["feature_a", "feature_b"])
            .orderBy(F.col("identical").desc(), F.col("abs_corr").desc(), "feature_a", "feature_b"))


def feature_auc(df, label, features, base):
    """AUC of every feature on its own, every class against the base class, over all
    rows. Features that are constant for a pair are left out."""
    sums = pair_rank_sums(df, label, base, features)
    return _auc(sums)


def _auc(sums):
    auc = F.col("wins2") / 2 / F.col("n") / F.col("n_base")
    return (sums.where("lowest < highest")
            .select("class", "feature", "n", auc.alias("auc"),
                    (F.abs(auc - 0.5) * 2).alias("separation")))


def _none(x):
    return None if x is None or np.isnan(x) else float(x)


def filled_auc(df, label, features, base):
    """AUC against the whole base class, missing values filled with the base medians; nothing is
    capped or shipped. Returns (auc table, filled other rows, base medians)."""
    features = list(features)
    own = df.where(ref(label) == F.lit(base))
    # one row per feature
    medians = {f: None for f in features} | {
        r["feature"]: _none(r["median"]) for r in group_medians(own, features, label).collect()}
    filled = df.where(ref(label).isNotNull()).withColumns({
        f: F.coalesce(ref(f).cast("double"), F.lit(medians[f]).cast("double")) for f in features})
    return feature_auc(filled, label, features, base), filled.where(ref(label) != F.lit(base)), medians


def capped_auc(df, label, ids, features, base, cap, seed=0):
    """The same with the base class cut to ``cap`` rows if it has more."""
    return filled_auc(undersample(df, label, ids, base, cap, seed), label, features, base)


def signatures(df, label, ids, features, base, top=5, base_cap=None, seed=0):
    """Per class, the ``top`` features that separate it best from the base class on
    their own, with direction and both medians. Equal scores go to the feature
    that sorts last, as scores are compared together with names. All rows count,
    unless ``base_cap`` asks for a sample of the base class."""
    if base_cap is None:
        auc, others, medians = filled_auc(df, label, features, base)
    else:
        auc, others, medians = capped_auc(df, label, ids, features, base, base_cap, seed)
    order = Window.partitionBy("class").orderBy(
        F.col("separation").desc(), F.col("feature").desc(), F.col("auc").desc())
    best = auc.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    own = group_medians(others, list(features), label).select(
        F.col("group").alias("class"), "feature", F.col("median").alias("median_class"))
    base_rows = [(f, m) for f, m in medians.items()]
    base_table = local_table(df.sparkSession, base_rows, "feature string, median_base double")
    return (best.join(own, ["class", "feature"]).join(base_table, "feature").select(
        "class", "rank", "feature", F.round("separation", 3).alias("separation"),
        F.when(F.col("auc") > 0.5, "higher").otherwise("lower").alias("class_is"),
        "median_class", "median_base", "n"))
