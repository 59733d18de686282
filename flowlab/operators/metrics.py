"""Classification metrics from confusion counts.

The scored rows are reduced once, map-side, to counts per (group, label,
prediction); everything else works on those at most K*K rows per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.tables import ref, value_of


def confusion_counts(scored, label="label", prediction="prediction", by=()):
    return scored.groupBy(*[ref(c) for c in by], ref(label).alias("label"),
                          ref(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts, classes):
    """Dense matrix as rows (label, prediction, n), zeros included.

    ``classes``: one column, label. The K*K cells are the result itself, so the
    class list is spelled out as an array and exploded against the classes."""
    vocabulary = value_of(classes.agg(F.array_sort(F.collect_set("label")).alias("v")), "v")
    cells = classes.select("label").distinct().select(
        "label", F.explode(vocabulary).alias("prediction"))
    return (cells.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def class_tallies(counts, by=()):
    """Support, predicted and correct rows per class that occurs as label or prediction."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.alias("correct")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("correct")))
    return (counts.select(*[ref(c) for c in by], F.inline(sides))
            .groupBy(*[ref(c) for c in by], "class")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                 F.sum("correct").alias("correct")))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class_report(counts, by=()):
    """Precision, recall, F1 and support per class; 0 where nothing can be divided."""
    t = class_tallies(counts, by)
    return t.select(
        *[ref(c) for c in by], "class",
        _ratio(F.col("correct"), F.col("predicted")).alias("precision"),
        _ratio(F.col("correct"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("correct"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "correct")


def classification_summary(counts, by=(), n_classes=None):
    """Accuracy with macro and weighted precision, recall and F1.

    Macro averages run over the classes seen as label or prediction, or over
    ``n_classes`` classes, absent ones counting as 0."""
    report = per_class_report(counts, by)
    k = F.lit(float(n_classes)) if n_classes is not None else F.count(F.lit(1))
    total = F.sum("support")
    macro = [(F.sum(m) / k).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}")
                for m in ("precision", "recall", "f1")]
    return report.groupBy(*[ref(c) for c in by]).agg(
        total.alias("n"), _ratio(F.sum("correct"), total).alias("accuracy"), *macro, *weighted)


def run_metrics(counts, by=(), classes=None):
    """Wide run row: summary plus recall::<class> and f1::<class> columns."""
    summary = classification_summary(counts, by)
    if not classes:
        return summary
    report = per_class_report(counts, by)
    wide = report.groupBy(*[ref(c) for c in by]).agg(*[
        F.coalesce(F.max(F.when(F.col("class") == F.lit(c), F.col(m))), F.lit(0.0))
        .alias(f"{m}::{c}") for m in ("recall", "f1") for c in classes])
    if not by:
        return summary.withColumns({c: value_of(wide, ref(c)) for c in wide.columns})
    return summary.join(wide, list(by))


def report_text(counts, by=()):
    """The per-class report as text lines with four digits."""
    return per_class_report(counts, by).select(
        *[ref(c) for c in by], F.col("class").cast("string").alias("class"),
        F.format_string("%26s %12.4f %9.4f %9.4f %9d", F.col("class").cast("string"),
                        F.round("precision", 4), F.round("recall", 4), F.round("f1", 4), "support").alias("line"))
