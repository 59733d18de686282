"""Profiles, copies, class balance and the end-to-end preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.scalars import clean_label, finite_or_null
from flowlab.operators import audit, separability
from flowlab.plans import fixtures as X
from flowlab.plans.registry import query
from flowlab.session import scratch_path
from flowlab.sources import results
from flowlab.tables import ref, settled, spread


@query("rows_per_source", X.with_sql(X.EVENTS_SQL, """
SELECT CASE WHEN grouping(day) = 1 THEN 'TOTAL' ELSE day END AS source, count(*) AS rows, 7 AS columns
FROM events_t GROUP BY ROLLUP (day)"""))
def _(spark, sf):
    return audit.rows_per_source(X.events(spark, sf), "day")


@query("constant_columns", X.with_sql(X.FLOWS_SQL, """
SELECT c AS "column" FROM (
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS c, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM flows"
    for c in X.FLOW_FEATURES) + ") WHERE n <= 1"))
def _(spark, sf):
    return audit.constant_columns(X.flows(spark, sf), X.FLOW_FEATURES)


@query("missing_profile", X.with_sql(X.FLOWS_SQL, """
SELECT 'rate' AS "column", count(*) - count(rate) AS missing,
  round((count(*) - count(rate)) * 100.0 / count(*), 6)::DOUBLE AS percent FROM flows"""))
def _(spark, sf):
    return audit.missing_profile(X.flows(spark, sf), X.FLOW_FEATURES).withColumn(
        "percent", F.round("percent", 6))


DUPLICATES_SQL = """groups AS (SELECT label, day, quantity, discount, tax, count(*) AS c FROM copies GROUP BY ALL),
per AS (SELECT label, sum(c - 1) AS duplicates, sum(c) AS rows FROM groups GROUP BY label)"""


@query("duplicate_profile", X.with_sql(X.COPIES_SQL, DUPLICATES_SQL, """
SELECT label, CAST(duplicates AS BIGINT) AS duplicates, CAST(rows AS BIGINT) AS rows,
  round(duplicates * 100.0 / rows, 6)::DOUBLE AS percent FROM per WHERE duplicates > 0
UNION ALL SELECT 'TOTAL', CAST(sum(duplicates) AS BIGINT), CAST(sum(rows) AS BIGINT),
  round(sum(duplicates) * 100.0 / sum(rows), 6)::DOUBLE FROM per"""))
def _(spark, sf):
    return audit.duplicate_profile(X.copies(spark, sf), "label").withColumn(
        "percent", F.round("percent", 6))


@query("duplicate_share", X.with_sql(X.COPIES_SQL, """groups AS (SELECT label, day, quantity, discount, tax, count(*) AS c FROM copies GROUP BY ALL)""", """
SELECT label, CAST(sum(c - 1) AS BIGINT) AS removed, count(*) AS kept,
  round(sum(c - 1) / sum(c), 6)::DOUBLE AS share FROM groups GROUP BY label"""))
def _(spark, sf):
    return audit.duplicate_share(X.copies(spark, sf), "label").withColumn("share", F.round("share", 6))


@query("duplicate_share_features", X.with_sql(X.COPIES_SQL, """
SELECT count(*) AS rows, count(DISTINCT (quantity, discount, tax)) AS distinct_rows,
  round(1 - count(DISTINCT (quantity, discount, tax)) / count(*), 6) AS share FROM copies"""))
def _(spark, sf):
    return audit.duplicate_share_features(X.copies(spark, sf), ["quantity", "discount", "tax"]).withColumn(
        "share", F.round("share", 6))


@query("dedupe_exact", X.with_sql(X.COPIES_SQL, "SELECT DISTINCT * FROM copies"))
def _(spark, sf):
    return audit.dedupe(X.copies(spark, sf))


@query("dedupe_documents", "SELECT DISTINCT text, lang FROM documents")
def _(spark, sf):
    return audit.dedupe(X.table(spark, sf, "documents").select("text", "lang"))


@query("class_distribution", X.with_sql(X.FLOWS_SQL, """
SELECT CASE WHEN grouping(label) = 1 THEN 'TOTAL' ELSE label END AS label, count(*) AS rows,
  round(count(*) * 100.0 / (SELECT count(*) FROM flows), 6)::DOUBLE AS percent FROM flows GROUP BY ROLLUP (label)"""))
def _(spark, sf):
    return audit.class_distribution(X.flows(spark, sf), "label").withColumn(
        "percent", F.round("percent", 6))


@query("imbalance_ratio", X.with_sql(X.FLOWS_SQL, """
SELECT count(*) AS classes, max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS ratio
FROM (SELECT label, count(*) AS n FROM flows GROUP BY label)"""))
def _(spark, sf):
    return audit.imbalance_ratio(X.flows(spark, sf), "label").withColumn("ratio", F.round("ratio", 6))


@query("conservation", X.with_sql(X.COPIES_SQL, """
SELECT CAST(sum(c) AS BIGINT) AS raw, CAST(sum(c - 1) AS BIGINT) AS duplicates, count(*) AS kept
FROM (SELECT count(*) AS c FROM copies GROUP BY ALL, label, day, quantity, discount, tax)""".replace(
    "GROUP BY ALL, ", "GROUP BY ")))
def _(spark, sf):
    return audit.conservation(X.copies(spark, sf), "label")


PAIRS = [("quantity", "qty_copy"), ("quantity", "price"), ("discount", "tax"), ("rate", "price")]


@query("identical_columns", X.with_sql(X.FLOWS_SQL, "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, bool_and({a} IS NOT DISTINCT FROM {b}) AS identical FROM flows"
    for a, b in PAIRS)))
def _(spark, sf):
    return audit.identical_pairs(X.flows(spark, sf), PAIRS)


@query("distinct_measurements", X.with_sql(X.FLOWS_SQL, """
SELECT CAST(8 AS BIGINT) AS features, CAST(CASE WHEN bool_and(quantity IS NOT DISTINCT FROM qty_copy) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(8 - CASE WHEN bool_and(quantity IS NOT DISTINCT FROM qty_copy) THEN 1 ELSE 0 END AS BIGINT) AS measurements FROM flows"""))
def _(spark, sf):
    return audit.distinct_measurements(X.flows(spark, sf), X.FLOW_FEATURES)


@query("redundant_pairs", X.with_sql(X.FLOWS_SQL, "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 4) AS abs_corr, "
    f"bool_and({a} IS NOT DISTINCT FROM {b}) AS identical FROM flows"
    for i, a in enumerate(X.LIVE_FEATURES) for b in X.LIVE_FEATURES[i + 1:]) + ") WHERE abs_corr >= 0.6"))
def _(spark, sf):
    found = separability.correlation_pairs(X.flows(spark, sf), X.FLOW_FEATURES, threshold=0.59995)
    return found.withColumn("abs_corr", F.round("abs_corr", 4))


def _flagship(spark, sf):
    """Clean, drop constants, profile missing values and copies, keep one copy of
    each record and count the classes: (section, item, n, percent) rows."""
    raw = X.flows(spark, sf).drop("flow_id")
    features = X.FLOW_FEATURES
    clean = raw.select(*[finite_or_null(ref(c)).cast("float").alias(c) for c in features],
                       clean_label(F.col("label")).alias("label"), "day")
    profile = settled(audit.column_profile(clean, features))
    constant = [r["column"] for r in profile.where("constant").collect()]
    live = clean.drop(*constant)
    zero = F.lit(None).cast("double")
    # one shuffle of the records serves the copies and the class counts
    per_label = audit.copy_counts(spread(live), live.columns).groupBy("label").agg(
        F.sum(F.col("copies") - 1).alias("duplicates"), F.count(F.lit(1)).alias("kept"))
    cells = per_label.rollup("label").agg(
        F.sum("duplicates").alias("duplicates"), F.sum("kept").alias("kept"),
        F.grouping("label").alias("total")).withColumn(
        "item", F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("label")))
    everything = F.col("duplicates") + F.col("kept")
    parts = [
        profile.where("constant").select(F.lit("constant").alias("section"), F.col("column").alias("item"),
                                         F.col("rows").alias("n"), zero.alias("percent")),
        profile.where("missing > 0").select(
            F.lit("missing").alias("section"), F.col("column").alias("item"), F.col("missing").alias("n"),
            (F.col("missing") * 100.0 / F.col("rows")).alias("percent")),
        cells.select(F.inline(F.array(
            F.struct(F.lit("duplicates").alias("section"), F.col("item"), F.col("duplicates").alias("n"),
                     (F.col("duplicates") * 100.0 / everything).alias("percent")),
            F.struct(F.lit("kept").alias("section"), F.col("item"), F.col("kept").alias("n"),
                     (F.col("kept") * 100.0 / everything).alias("percent"))))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("percent", F.round("percent", 6))


query("prepare_audit", X.with_sql(X.FLOWS_SQL, """clean AS (
  SELECT CAST(quantity AS FLOAT) AS quantity, CAST(price AS FLOAT) AS price, CAST(discount AS FLOAT) AS discount,
    CAST(tax AS FLOAT) AS tax, CAST(line_no AS FLOAT) AS line_no, CAST(rate AS FLOAT) AS rate,
    CAST(qty_copy AS FLOAT) AS qty_copy, label, day FROM flows)""", """groups AS (
  SELECT quantity, price, discount, tax, line_no, rate, qty_copy, label, day, count(*) AS c FROM clean
  GROUP BY quantity, price, discount, tax, line_no, rate, qty_copy, label, day)""", """per AS (
  SELECT CASE WHEN grouping(label) = 1 THEN 'TOTAL' ELSE label END AS item,
    CAST(sum(c - 1) AS BIGINT) AS duplicates, count(*) AS kept FROM groups GROUP BY ROLLUP (label))""", """
SELECT 'constant' AS section, 'const0' AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS percent FROM flows
UNION ALL SELECT 'missing', 'rate', count(*) - count(rate), round((count(*) - count(rate)) * 100.0 / count(*), 6) FROM flows
UNION ALL SELECT 'duplicates', item, duplicates, round(duplicates * 100.0 / (duplicates + kept), 6) FROM per
UNION ALL SELECT 'kept', item, kept, round(kept * 100.0 / (duplicates + kept), 6) FROM per"""))(_flagship)


def _report_texts(spark, sf):
    """One audit text per source, with copies per class ([4]) and kept classes ([5])."""
    t = X.copies(spark, sf)
    per = audit.copy_counts(t, t.columns).groupBy("day", "label").agg(
        F.sum(F.col("copies") - 1).alias("removed"), F.count(F.lit(1)).alias("kept"))
    return audit.class_report_texts(per, "day", "label")


REPORT_SQL = """per AS (SELECT day AS report, label AS class, CAST(sum(c - 1) AS BIGINT) AS removed, count(*) AS kept
  FROM (SELECT label, day, quantity, discount, tax, count(*) AS c FROM copies
        GROUP BY label, day, quantity, discount, tax) GROUP BY 1, 2)"""


@query("audit_report_lines", X.with_sql(X.COPIES_SQL, REPORT_SQL, """
SELECT report, printf('    %-32s %10s %8.4f%%', class, format('{:,}', kept),
  kept * 100.0::DOUBLE / sum(kept) OVER (PARTITION BY report)) AS line FROM per"""))
def _(spark, sf):
    path = results.write_report_texts(_report_texts(spark, sf), scratch_path(spark, "reports"))
    texts = results.read_report_texts(spark, path)
    section = F.regexp_extract("text", r"(?s)\[5\][^\n]*\n(.*?)\n    TOTAL", 1)
    return texts.select("report", F.explode(F.split(section, "\n")).alias("line"))


@query("parse_reports", X.with_sql(X.COPIES_SQL, REPORT_SQL, """
SELECT report, class, removed, kept FROM per"""))
def _(spark, sf):
    path = results.write_report_texts(_report_texts(spark, sf), scratch_path(spark, "reports"))
    return results.parse_report_classes(results.read_report_texts(spark, path))


@query("parse_report_totals", X.with_sql(X.COPIES_SQL, REPORT_SQL, """
SELECT report, CAST(sum(kept) AS BIGINT) AS total, count(*) AS classes,
  CAST(round_even(max(kept) / min(kept), 0) AS BIGINT) AS ratio, CAST(sum(removed) AS BIGINT) AS removed,
  CAST(sum(removed) + sum(kept) AS BIGINT) AS raw FROM per GROUP BY report"""))
def _(spark, sf):
    path = results.write_report_texts(_report_texts(spark, sf), scratch_path(spark, "reports"))
    return results.parse_report_totals(results.read_report_texts(spark, path))


@query("label_scan", X.with_sql(X.FLOWS_SQL, "SELECT label, count(*) AS n FROM flows GROUP BY label"))
def _(spark, sf):
    return X.flows(spark, sf).select("label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("attack_classes", X.with_sql(X.FLOWS_SQL, "SELECT DISTINCT label FROM flows WHERE label <> 'BENIGN'"))
def _(spark, sf):
    return X.flows(spark, sf).select("label").where(F.col("label") != X.BENIGN).distinct()


@query("distinct_values", """
SELECT event_type, min(event_id) AS first_seen, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place
FROM events GROUP BY event_type""")
def _(spark, sf):
    from pyspark.sql import Window

    seen = X.table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first_seen"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("first_seen")))


@query("union_sources", """
SELECT 'customer' AS origin, c_name AS name, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier""")
def _(spark, sf):
    a = X.table(spark, sf, "customer").select(
        F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = X.table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("origin"), F.col("s_name").alias("name"))
    return a.unionByName(b)
