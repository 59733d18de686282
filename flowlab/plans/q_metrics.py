"""Preprocessing statistics, classification metrics and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import leakage, metrics, prep, sampling
from flowlab.plans import fixtures as X
from flowlab.plans.registry import query
from flowlab.tables import ref

COUNTS_SQL = f"""scored AS (SELECT flow_id, day, label, {X.RULE_SQL} AS prediction FROM flows)"""


def tallies_sql(source, by="", digits=6, n_classes="count(*)"):
    """SQL twin of the per-class report and the summary over ``source``(by, label, prediction)."""
    g = f"{by}, " if by else ""
    return f"""tally AS (SELECT {g}class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS correct
  FROM (SELECT {g}label AS class, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM {source}
        UNION ALL SELECT {g}prediction, 0, 1, 0 FROM {source}) GROUP BY {g}class)""", f"""report AS (
  SELECT {g}class, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END::DOUBLE AS precision,
    CASE WHEN support > 0 THEN correct / support ELSE 0 END::DOUBLE AS recall,
    2.0::DOUBLE * correct / (support + predicted) AS f1, support, correct FROM tally)""", f"""summary AS (
  SELECT {g}CAST(sum(support) AS BIGINT) AS n, sum(correct) / sum(support) AS accuracy,
    sum(precision) / {n_classes} AS macro_precision, sum(recall) / {n_classes} AS macro_recall, sum(f1) / {n_classes} AS macro_f1,
    sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1
  FROM report {'GROUP BY ' + by if by else ''})"""


METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1",
           "weighted_precision", "weighted_recall", "weighted_f1"]
ROUNDED_SQL = ", ".join(f"round({m}, 6)::DOUBLE AS {m}" for m in METRICS)


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("impute_mean", X.with_sql(X.FLOWS_SQL, X.split_sql("flows", "flow_id", 0.4), """mean AS (
  SELECT avg(rate) AS m FROM parts WHERE is_train)""", """
SELECT flow_id, is_train, round(coalesce(rate, m), 4) AS rate FROM parts, mean"""))
def _(spark, sf):
    t = sampling.stratified_split(X.flows(spark, sf), "label", ["flow_id"], 0.4)
    fills = prep.fill_values(t.where("is_train"), ["rate"])
    return prep.impute(t, fills).select("flow_id", "is_train", F.round("rate", 4).alias("rate"))


@query("impute_median", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, round(coalesce(rate, (SELECT median(rate) FROM flows)), 4) AS rate FROM flows"""))
def _(spark, sf):
    t = X.flows(spark, sf)
    fills = prep.fill_values(t, ["rate"], strategy="median")
    return prep.impute(t, fills).select("flow_id", F.round("rate", 4).alias("rate"))


SCALED = ["quantity", "price", "tax", "const0"]


@query("standard_scale", X.with_sql(X.FLOWS_SQL, X.split_sql("flows", "flow_id", 0.4), "stats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED) + " FROM parts WHERE is_train)",
    "SELECT flow_id, is_train, " + ", ".join(
        f"round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END, 6) AS {c}" for c in SCALED)
    + " FROM parts, stats"))
def _(spark, sf):
    t = sampling.stratified_split(X.flows(spark, sf), "label", ["flow_id"], 0.4)
    means, spreads = prep.column_statistics(t.where("is_train"), SCALED)
    out = prep.scale(t, means, spreads)
    return rounded(out.select("flow_id", "is_train", *SCALED), SCALED)


PREP = ["price", "rate"]


@query("prep_pipeline", X.with_sql(X.FLOWS_SQL, X.split_sql("flows", "flow_id", 0.2), """mean AS (
  SELECT avg(rate) AS fill FROM parts WHERE is_train)""", """filled AS (
  SELECT flow_id, is_train, price, coalesce(rate, fill) AS rate FROM parts, mean)""", """stats AS (
  SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(rate) AS mr, stddev_pop(rate) AS sr FROM filled WHERE is_train)""", """
SELECT flow_id, round((price - mp) / sp, 6) AS price, round((rate - mr) / sr, 6) AS rate FROM filled, stats WHERE NOT is_train"""))
def _(spark, sf):
    t = sampling.stratified_split(X.flows(spark, sf), "label", ["flow_id"], 0.2)
    test, = prep.prepare(t.where("is_train"), [t.where("not is_train")], PREP)
    return rounded(test.select("flow_id", *PREP), PREP)


@query("confusion_matrix", X.with_sql(X.FLOWS_SQL, COUNTS_SQL, """labels_t AS (SELECT DISTINCT label FROM flows)""", """
SELECT a.label, b.label AS prediction, (SELECT count(*) FROM scored s WHERE s.label = a.label AND s.prediction = b.label) AS n
FROM labels_t a, labels_t b"""))
def _(spark, sf):
    scored = X.rule(X.flows(spark, sf))
    return metrics.confusion_matrix(metrics.confusion_counts(scored), scored.select("label").distinct())


@query("per_class_report", X.with_sql(X.FLOWS_SQL, COUNTS_SQL, *tallies_sql("scored"), """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""))
def _(spark, sf):
    counts = metrics.confusion_counts(X.rule(X.flows(spark, sf)))
    return rounded(metrics.per_class_report(counts).drop("correct"), ["precision", "recall", "f1"])


@query("report_text", X.with_sql(X.FLOWS_SQL, COUNTS_SQL, *tallies_sql("scored", "day"), """
SELECT day, class, printf('%26s %12.4f %9.4f %9.4f %9d', class, round(precision, 4), round(recall, 4), round(f1, 4), support) AS line FROM report"""))
def _(spark, sf):
    return metrics.report_text(metrics.confusion_counts(X.rule(X.flows(spark, sf)), by=["day"]), by=["day"])


@query("classification_summary", X.with_sql(X.FLOWS_SQL, COUNTS_SQL, *tallies_sql("scored"), f"""
SELECT n, {ROUNDED_SQL} FROM summary"""))
def _(spark, sf):
    counts = metrics.confusion_counts(X.rule(X.flows(spark, sf)))
    return rounded(metrics.classification_summary(counts), METRICS)


@query("classification_summary_by_source", X.with_sql(X.FLOWS_SQL, COUNTS_SQL, *tallies_sql("scored", "day"), f"""
SELECT day, n, {ROUNDED_SQL} FROM summary"""))
def _(spark, sf):
    counts = metrics.confusion_counts(X.rule(X.flows(spark, sf)), by=["day"])
    return rounded(metrics.classification_summary(counts, by=["day"]), METRICS)


@query("document_quality_summary", X.with_sql(X.QUALITY_SQL, *tallies_sql("quality_t"), f"""
SELECT n, {ROUNDED_SQL} FROM summary"""))
def _(spark, sf):
    counts = metrics.confusion_counts(X.quality(spark, sf))
    return rounded(metrics.classification_summary(counts), METRICS)


@query("run_metrics", X.with_sql(X.FLOWS_SQL, COUNTS_SQL, *tallies_sql("scored", "day"), f"""wide AS (
  SELECT day, {', '.join(f"coalesce(max(CASE WHEN class = '{c}' THEN {m} END), 0) AS {chr(34)}{m}::{c}{chr(34)}" for m in ('recall', 'f1') for c in ('BENIGN', 'MID', 'RARE'))}
  FROM report GROUP BY day)""", f"""
SELECT day, n, {ROUNDED_SQL}, {', '.join(f'round({chr(34)}{m}::{c}{chr(34)}, 6)::DOUBLE AS {chr(34)}{m}::{c}{chr(34)}' for m in ('recall', 'f1') for c in ('BENIGN', 'MID', 'RARE'))}
FROM summary JOIN wide USING (day)"""))
def _(spark, sf):
    counts = metrics.confusion_counts(X.rule(X.flows(spark, sf)), by=["day"])
    out = metrics.run_metrics(counts, by=["day"], classes=["BENIGN", "MID", "RARE"])
    return out.select("day", "n", *[F.round(ref(c), 6).alias(c) for c in out.columns if c not in ("day", "n")])


KEY = ["quantity", "discount", "tax", "label"]
SPLIT_SQL = X.split_sql("copies", "flow_id", 0.4)
SAME_SQL = " AND ".join(f"b.{c} IS NOT DISTINCT FROM a.{c}" for c in KEY)
LEAK_SQL = f"""known AS (SELECT DISTINCT quantity, discount, tax, label, true AS hit FROM parts WHERE is_train)""", f"""flagged AS (
  SELECT a.*, b.hit IS NOT NULL AS leaked FROM parts a LEFT JOIN known b ON {SAME_SQL} WHERE NOT a.is_train)"""


def split_copies(spark, sf):
    return sampling.stratified_split(X.copies_with_id(spark, sf), "label", ["flow_id"], 0.4)


@query("leaked_rows", X.with_sql(X.COPIES_ID_SQL, SPLIT_SQL, *LEAK_SQL, "SELECT flow_id, leaked FROM flagged"))
def _(spark, sf):
    t = split_copies(spark, sf)
    return leakage.flag_leaked(t.where("not is_train"), t.where("is_train"), KEY).select("flow_id", "leaked")


@query("leaked_share", X.with_sql(X.COPIES_ID_SQL, SPLIT_SQL, *LEAK_SQL, """
SELECT count(*) AS n_test, count(*) FILTER (leaked) AS n_leaked, round(count(*) FILTER (leaked) / count(*), 6) AS leaked_share FROM flagged"""))
def _(spark, sf):
    return leakage.leaked_share(split_copies(spark, sf), KEY).withColumn(
        "leaked_share", F.round("leaked_share", 6))


LEAK_RULE = "CASE WHEN quantity > 30 THEN 'N' WHEN discount > 0.05 THEN 'A' ELSE 'R' END"
SEGMENT_SQL = f"""scored AS (SELECT label, {LEAK_RULE} AS prediction, CASE WHEN leaked THEN 'leaked' ELSE 'unseen' END AS segment FROM flagged)"""


def _segments(spark, sf):
    t = split_copies(spark, sf).withColumn("prediction", F.expr(LEAK_RULE))
    return leakage.scored_segments(t, KEY)


@query("segment_metrics", X.with_sql(
    X.COPIES_ID_SQL, SPLIT_SQL, *LEAK_SQL, SEGMENT_SQL, """every AS (
  SELECT * FROM scored UNION ALL SELECT label, prediction, 'overall' FROM scored)""", *tallies_sql("every", "segment", n_classes="3"), """
SELECT segment, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM summary"""))
def _(spark, sf):
    return rounded(leakage.segment_metrics(_segments(spark, sf), n_classes=3), ["accuracy", "macro_f1"])


GAP = ["accuracy_overall", "accuracy_leaked", "accuracy_unseen", "leaked_share", "gap", "contribution"]


@query("leakage_summary", X.with_sql(X.COPIES_ID_SQL, SPLIT_SQL, *LEAK_SQL, SEGMENT_SQL, """sums AS (
  SELECT count(*) AS n_test, count(*) FILTER (segment = 'leaked') AS n_leaked,
    count(*) FILTER (label = prediction) / count(*) AS accuracy_overall,
    count(*) FILTER (label = prediction AND segment = 'leaked') / nullif(count(*) FILTER (segment = 'leaked'), 0) AS accuracy_leaked,
    count(*) FILTER (label = prediction AND segment = 'unseen') / nullif(count(*) FILTER (segment = 'unseen'), 0) AS accuracy_unseen
  FROM scored)""", """
SELECT n_test, n_leaked, round(accuracy_overall, 6) AS accuracy_overall, round(accuracy_leaked, 6) AS accuracy_leaked,
  round(accuracy_unseen, 6) AS accuracy_unseen, round(n_leaked / n_test, 6) AS leaked_share,
  round(accuracy_leaked - accuracy_unseen, 6) AS gap,
  round((accuracy_leaked - accuracy_unseen) * n_leaked / n_test, 6) AS contribution FROM sums"""))
def _(spark, sf):
    return rounded(leakage.leakage_summary(_segments(spark, sf)), GAP)
