"""Whole studies on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import leakage, metrics, models, runs
from flowlab.plans import fixtures as X
from flowlab.plans import studies
from flowlab.plans.q_metrics import METRICS, ROUNDED_SQL, rounded, tallies_sql
from flowlab.plans.q_models import NB_SQL, nb_sql, predictions
from flowlab.plans.registry import query

LIVE = ["quantity", "price", "discount", "tax", "rate"]


@query("naive_bayes_summary", X.with_sql(*NB_SQL, *tallies_sql("guessed"), f"""
SELECT n, {ROUNDED_SQL} FROM summary"""))
def _(spark, sf):
    counts = metrics.confusion_counts(predictions("naive_bayes", spark, sf))
    return rounded(metrics.classification_summary(counts), METRICS)


@query("compare_classifiers")
def _(spark, sf):
    t = X.flows(spark, sf).select("flow_id", "label", *LIVE)
    done = studies.compare_classifiers(t, "label", ["flow_id"], LIVE, ["lda"], [0.4])
    return studies.compare_classifiers(t, "label", ["flow_id"], LIVE,
                                       ["naive_bayes", "lda", "qda", "decision_tree", "random_forest"],
                                       [0.2, 0.4, 0.6], done=done)


@query("grid_eval")
def _(spark, sf):
    t, names = X.vector_columns(spark, sf)
    plan = [dict(test_size=0.4, method="none", kernel="none", components=0),
            dict(test_size=0.4, method="kpca", kernel="rbf", components=15),
            dict(test_size=0.4, method="kpca", kernel="cosine", components=10)]
    return studies.reduction_grid(t, "label", ["id"], names, plan, ["naive_bayes", "knn"], sample=None)


@query("grid_eval_linear")
def _(spark, sf):
    t, names = X.vector_columns(spark, sf)
    plan = [dict(test_size=0.2, method=m, components=15) for m in ("pca", "lda")]
    return studies.reduction_grid(t, "label", ["id"], names, plan, ["qda", "knn"], sample=None)


@query("feature_study")
def _(spark, sf):
    tables = studies.feature_study(X.flows(spark, sf), "label", ["flow_id"], LIVE, X.BENIGN)
    return tables["importance"]


@query("imbalance_study")
def _(spark, sf):
    return studies.imbalance_study(
        X.flows(spark, sf), "label", ["flow_id"], ["quantity", "price", "discount", "tax"], X.BENIGN,
        names=["decision_tree", "random_forest"], keep=10_000, target=2_000)


@query("chart_rare_recall")
def _(spark, sf):
    long = studies.imbalance_study(
        X.flows(spark, sf), "label", ["flow_id"], ["quantity", "price", "discount", "tax"], X.BENIGN,
        names=["decision_tree"], keep=10_000, target=2_000)
    row = long.withColumn("row_label", F.concat_ws("  /  ", "model", "strategy"))
    return runs.pivot_metric(row, ["row_label"], "class", ["RARE", "MID"], "recall")


@query("chart_per_class_f1", X.with_sql(*NB_SQL, *tallies_sql("guessed"), """
SELECT class, round(f1, 6) AS f1, support, CAST(row_number() OVER (ORDER BY support DESC, class) AS INTEGER) AS place FROM report"""))
def _(spark, sf):
    from pyspark.sql import Window

    report = metrics.per_class_report(metrics.confusion_counts(predictions("naive_bayes", spark, sf)))
    order = Window.partitionBy().orderBy(F.col("support").desc(), "class")  # one row per class
    return report.select("class", F.round("f1", 6).alias("f1"), "support", F.row_number().over(order).alias("place"))


ABLATION = {"all": [], "no quantity": ["quantity"], "neither": ["quantity", "discount"]}
KEPT = {name: [f for f in LIVE if f not in gone] for name, gone in ABLATION.items()}
TAGS = {name: f"a{i}_" for i, name in enumerate(ABLATION)}
SCORES = ["accuracy", "macro_f1", "weighted_f1"]
SCORES_SQL = ", ".join(f"round({m}, 6)::DOUBLE AS {m}" for m in SCORES)


@query("ablation_study", X.with_sql(
    X.FLOWS_SQL, *[part for name, tag in TAGS.items() for part in nb_sql("flows", "flow_id", KEPT[name], tag=tag)],
    "every AS (" + " UNION ALL ".join(
        f"SELECT '{name}|{len(KEPT[name])}' AS run, label, prediction FROM {tag}guessed" for name, tag in TAGS.items()) + ")",
    *tallies_sql("every", "run"), f"""
SELECT split_part(run, '|', 1) AS feature_set, CAST(split_part(run, '|', 2) AS INTEGER) AS n_features, 'naive_bayes' AS model,
  {SCORES_SQL} FROM summary"""))
def _(spark, sf):
    return rounded(studies.ablation_study(X.flows(spark, sf), "label", ["flow_id"], LIVE, ABLATION, ["naive_bayes"])
                   .drop("fit_seconds"), SCORES)


LEAK_FEATURES = ["quantity", "discount", "tax"]


@query("dup_effect_study", X.with_sql(
    X.COPIES_ID_SQL, "once AS (SELECT quantity, discount, tax, label, min(flow_id) AS flow_id FROM copies GROUP BY ALL)",
    *nb_sql("copies", "flow_id", LEAK_FEATURES, tag="k_"), *nb_sql("once", "flow_id", LEAK_FEATURES, tag="r_"),
    """every AS (SELECT 'duplicates kept' AS run, label, prediction FROM k_guessed
  UNION ALL SELECT 'duplicates removed', label, prediction FROM r_guessed)""", *tallies_sql("every", "run"), f"""
SELECT run AS condition, 'naive_bayes' AS model, CASE WHEN run = 'duplicates kept' THEN (SELECT round(1 - count(DISTINCT (quantity, discount, tax)) / count(*), 6) FROM copies)
  ELSE 0 END AS duplicate_share, {SCORES_SQL} FROM summary"""))
def _(spark, sf):
    return rounded(studies.duplicate_effect_study(X.copies_with_id(spark, sf), "label", ["flow_id"], LEAK_FEATURES,
                                                  ["naive_bayes"]).drop("fit_seconds"),
                   ["duplicate_share", *SCORES])


LEAK_NB_SQL = (
    X.COPIES_ID_SQL, *nb_sql("copies", "flow_id", LEAK_FEATURES, columns=", ".join(LEAK_FEATURES)),
    "known AS (SELECT DISTINCT label, " + ", ".join(LEAK_FEATURES) + ", true AS hit FROM parts WHERE is_train)",
    """scored AS (SELECT g.label, prediction, CASE WHEN hit THEN 'leaked' ELSE 'unseen' END AS segment FROM guessed g
  LEFT JOIN known k ON g.label = k.label AND """ + " AND ".join(f"g.{f} = k.{f}" for f in LEAK_FEATURES) + ")",
    "every AS (SELECT * FROM scored UNION ALL SELECT label, prediction, 'overall' FROM scored)")


@query("leakage_study", X.with_sql(*LEAK_NB_SQL, *tallies_sql("every", "segment", n_classes="3"), """
SELECT segment, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM summary"""))
def _(spark, sf):
    def score(train, rows):
        return models.fit_predict("naive_bayes", train, rows, "label", ["flow_id"], LEAK_FEATURES)

    segments = studies.leakage_study(X.copies_with_id(spark, sf), "label", ["flow_id"], LEAK_FEATURES, score)
    return rounded(leakage.segment_metrics(segments, n_classes=3), ["accuracy", "macro_f1"])


@query("baseline_sgd")
def _(spark, sf):
    return studies.baseline(X.flows(spark, sf), "label", ["flow_id"], LIVE)
