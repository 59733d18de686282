"""Profiles of a labelled table: constants, missing values, copies, class balance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.tables import ref


def rows_per_source(df, source, n_columns=None):
    """Rows per source and in total, with the column count of the table."""
    width = F.lit(n_columns if n_columns is not None else len(df.columns))
    counts = df.rollup(ref(source)).agg(F.count(F.lit(1)).alias("rows"),
                                        F.grouping(ref(source)).alias("total"))
    name = F.when(F.col("total") == 1, F.lit("TOTAL")).otherwise(ref(source))
    return counts.select(name.alias("source"), "rows", width.cast("int").alias("columns"))


def column_profile(df, columns):
    """One row per column: rows, missing, and whether all values are the same.

    A missing value counts as a value of its own, so a column holding {0, NULL}
    is not constant. Only minimum, maximum and counts travel, no distinct values."""
    parts = []
    for c in columns:
        x = ref(c)
        filled = F.count(x)
        parts.append(F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            (F.count(F.lit(1)) - filled).alias("missing"),
            ((filled == 0) | ((filled == F.count(F.lit(1))) & F.min(x).eqNullSafe(F.max(x))))
            .alias("constant")))
    return df.agg(F.array(*parts).alias("profile")).select(F.inline("profile"))


def constant_columns(df, columns):
    return column_profile(df, columns).where("constant").select("column")


def drop_constant(df, columns):
    """Drop the columns whose value never changes over the whole table."""
    names = [r["column"] for r in constant_columns(df, columns).collect()]
    return df.drop(*names)


def missing_profile(df, columns):
    """Missing count and percentage of the columns that have any."""
    profile = column_profile(df, columns).where("missing > 0")
    return profile.select("column", "missing",
                          (F.col("missing") * 100.0 / F.col("rows")).alias("percent"))


def copy_counts(df, key_columns, carry=()):
    """One row per distinct record with its number of copies. The count is a
    map-side aggregate, so a record copied over a third of the table still
    reaches its reducer as one row per task."""
    return df.groupBy(*[ref(c) for c in [*key_columns, *carry]]).agg(
        F.count(F.lit(1)).alias("copies"))


def duplicate_profile(df, label, key_columns=None):
    """Surplus copies per label and in total, with the share of all rows."""
    keys = list(key_columns or df.columns)
    carry = () if label in keys else (label,)
    per_label = copy_counts(df, keys, carry).groupBy(ref(label)).agg(
        F.sum(F.col("copies") - 1).alias("duplicates"), F.sum("copies").alias("rows"))
    totals = per_label.rollup(ref(label)).agg(
        F.sum("duplicates").alias("duplicates"), F.sum("rows").alias("rows"),
        F.grouping(ref(label)).alias("total"))
    name = F.when(F.col("total") == 1, F.lit("TOTAL")).otherwise(ref(label))
    return (totals.where((F.col("duplicates") > 0) | (F.col("total") == 1))
            .select(name.alias("label"), "duplicates", "rows",
                    (F.col("duplicates") * 100.0 / F.col("rows")).alias("percent")))


def duplicate_share(df, label, key_columns=None):
    """Share of each class removed as copies: copies / (kept + copies)."""
    keys = list(key_columns or df.columns)
    carry = () if label in keys else (label,)
    per_label = copy_counts(df, keys, carry).groupBy(ref(label).alias("label")).agg(
        F.sum(F.col("copies") - 1).alias("removed"), F.count(F.lit(1)).alias("kept"))
    share = F.coalesce(F.try_divide("removed", F.col("removed") + F.col("kept")), F.lit(0.0))
    return per_label.select("label", "removed", "kept", share.alias("share"))


def duplicate_share_features(df, features):
    """Share of rows whose feature vector was already seen, labels ignored."""
    return copy_counts(df, features).agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).select(
        "rows", "distinct_rows",
        (1 - F.col("distinct_rows") / F.col("rows")).alias("share"))


def dedupe(df, key_columns=None):
    """Keep one copy of every record. Copies agree on the key columns, so with
    all columns as key it does not matter which one is kept."""
    return df.dropDuplicates(list(key_columns)) if key_columns else df.dropDuplicates()


def class_distribution(df, label):
    """Rows and share per class plus a TOTAL row."""
    counts = df.rollup(ref(label)).agg(F.count(F.lit(1)).alias("rows"),
                                       F.grouping(ref(label)).alias("total"))
    # the rollup has one row per class, so its window is small
    all_rows = F.max(F.when(F.col("total") == 1, F.col("rows"))).over(Window.partitionBy())
    name = F.when(F.col("total") == 1, F.lit("TOTAL")).otherwise(ref(label))
    return counts.select(name.alias("label"), "rows",
                         (F.col("rows") * 100.0 / all_rows).alias("percent"))


def imbalance_ratio(df, label):
    """Number of classes and rows of the largest class per row of the smallest."""
    counts = df.groupBy(ref(label)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"),
        F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("ratio"))


def identical_pairs(df, pairs):
    """For given column pairs: are both columns equal in every row (missing = missing)?"""
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "feature_a string, feature_b string, identical boolean")
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                      F.bool_and(ref(a).eqNullSafe(ref(b))).alias("identical"))
             for a, b in pairs]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def distinct_measurements(df, features, pairs=None):
    """Features minus those that merely repeat an earlier one."""
    if pairs is None:
        pairs = equal_aggregate_pairs(df, features)
    copies = identical_pairs(df, pairs).where("identical").agg(
        F.countDistinct("feature_b").alias("copies"))
    return copies.select(F.lit(len(features)).cast("bigint").alias("features"), "copies",
                         (F.lit(len(features)) - F.col("copies")).alias("measurements"))


def equal_aggregate_pairs(df, features):
    """Pairs that can be identical at all: same filled count, minimum, maximum and
    order-free hash sum. One aggregate pass thins the p*(p-1)/2 pairs out."""
    cells = [F.struct(
        F.lit(c).alias("feature"), F.count(ref(c)).alias("filled"), F.min(ref(c)).alias("lowest"),
        F.max(ref(c)).alias("highest"), F.bit_xor(F.xxhash64(ref(c).cast("double"))).alias("mix"),
        F.sum(F.xxhash64(ref(c).cast("double")).bitwiseAND(0xFFFFFFFF)).alias("sum"))
        for c in features]
    marks = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).collect()
    seen = {}
    pairs = []
    for row in marks:
        mark = (row["filled"], row["lowest"], row["highest"], row["mix"], row["sum"])
        for earlier in seen.get(mark, []):
            pairs.append((earlier, row["feature"]))
        seen.setdefault(mark, []).append(row["feature"])
    return pairs


def complete_sources(expected, present):
    """Each expected source with the first of its accepted names that is present;
    sources with none of them stay in the result with a NULL name.

    ``expected``: source, place, name (place = order of preference);
    ``present``: name."""
    names = present.select(F.col("name").alias("found")).distinct()
    hits = expected.join(names, F.col("name") == F.col("found"), "left")
    best = F.min(F.when(F.col("found").isNotNull(), F.struct("place", "name")))
    return hits.groupBy("source").agg(best.getField("name").alias("name"))


def class_report_texts(per_class, report, label):
    """Audit texts, one row (report, text) per value of ``report``.

    ``per_class`` holds report, label, removed, kept. A text has one line per class
    and section, so the lines gathered per report are bounded by the classes."""
    rows = per_class.select(ref(report).cast("string").alias("report"), ref(label).alias("class"),
                            "removed", "kept")
    whole = Window.partitionBy("report")
    rows = rows.withColumn("total", F.sum("kept").over(whole))
    gone = F.struct(F.lit(4).alias("section"), (-F.col("removed")).alias("ord"), F.format_string(
        "       %-32s %9s", "class", with_thousands(F.col("removed"))).alias("line"))
    final = F.struct(F.lit(5).alias("section"), (-F.col("kept")).alias("ord"), F.format_string(
        "    %-32s %10s %8.4f%%", "class", with_thousands(F.col("kept")),
        F.col("kept") * F.lit(100.0) / F.col("total")).alias("line"))
    lines = rows.select("report", "removed", "kept", "total", F.when(F.col("removed") > 0, gone).alias("gone"),
                        final.alias("final")).groupBy("report").agg(
        F.sort_array(F.collect_list("gone")).alias("gone"),
        F.sort_array(F.collect_list("final")).alias("final"),
        F.sum("removed").alias("removed"), F.sum("kept").alias("kept"),
        F.count(F.lit(1)).alias("classes"), (F.max("kept") / F.min("kept")).alias("ratio"))
    raw = F.col("removed") + F.col("kept")
    text = F.concat_ws("\n", F.concat(
        F.array(F.lit("[4] Exact duplicate rows"),
                F.format_string("    %s of %s  (%.2f%%)", with_thousands(F.col("removed")), with_thousands(raw),
                                F.col("removed") * F.lit(100.0) / raw)),
        F.transform("gone", lambda x: x["line"]),
        F.array(F.lit("[5] Final class distribution")),
        F.transform("final", lambda x: x["line"]),
        F.array(F.format_string("    %-32s %10s", F.lit("TOTAL"), with_thousands(F.col("kept"))),
                F.format_string("    classes: %s   imbalance ratio: %s : 1", F.col("classes").cast("string"),
                                F.format_number(F.bround("ratio"), 0)))))
    return lines.select("report", text.alias("text"))


def with_thousands(column):
    return F.format_number(column.cast("bigint"), 0)


def conservation(df, label):
    """Raw rows = surplus copies + kept rows, as one row."""
    return copy_counts(df, df.columns).agg(
        F.sum("copies").alias("raw"), F.sum(F.col("copies") - 1).alias("duplicates"),
        F.count(F.lit(1)).alias("kept"))


