"""Sources and sinks: CSV ingest, completeness, Parquet, run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import audit
from flowlab.operators.sampling import take_rows, with_stable_id
from flowlab.plans import fixtures as X
from flowlab.plans.registry import query
from flowlab.session import scratch_path
from flowlab.sources import flows as src
from flowlab.sources import results
from flowlab.tables import ref

RAW_FEATURES = ["quantity", "price", "tax", "rate"]


def raw_csv(spark, sf):
    """The records as raw CSV, one folder per source: padded names, a header that
    occurs twice once trimmed, infinities, bad text, a non-ASCII label byte."""
    t = X.flows(spark, sf)
    rate = (F.when(F.col("rate").isNull() & (F.col("line_no") < 3), "Infinity")
            .when(F.col("rate").isNull() & (F.col("line_no") < 5), "NaN")
            .when(F.col("rate").isNull(), "x").otherwise(F.col("rate").cast("string")))
    label = F.concat(F.col("label"), F.lit(" \u0096 flow  "))
    raw = t.select(
        F.col("flow_id").alias("Flow ID"), F.col("quantity").cast("string").alias(" quantity"),
        F.col("price").cast("string").alias(" price "), F.col("tax").cast("string").alias("tax"),
        F.col("quantity").cast("string").alias("quantity "), rate.alias(" rate"),
        label.alias(" Label"), F.col("day").alias("part"))
    path = scratch_path(spark, "raw")
    (raw.write.partitionBy("part").option("encoding", "ISO-8859-1")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path, header=True))
    return path


def by_source(spark, path):
    """{source: file names} of the written folders."""
    files = src.files_below(spark, path, "*.csv").select(
        F.regexp_extract("path", r"part=([^/]+)/", 1).alias("source"), "name", "path").collect()
    names, paths = {}, {}
    for r in files:
        names.setdefault(r["source"], []).append(r["name"])
        paths.setdefault(r["source"], []).append(r["path"])
    return names, paths


def _folders(paths):
    return sorted({p.rsplit("/", 1)[0] for group in paths.values() for p in group})


def scan(spark, sf):
    _, paths = by_source(spark, raw_csv(spark, sf))
    return src.read_flow_csv(spark, _folders(paths))


@query("scan_csv_flows", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, CAST(CAST(quantity AS FLOAT) AS DOUBLE) AS quantity, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price,
  CAST(CAST(tax AS FLOAT) AS DOUBLE) AS tax, CAST(CAST(rate AS FLOAT) AS DOUBLE) AS rate,
  concat(label, ' - flow') AS label FROM flows"""))
def _(spark, sf):
    raw = scan(spark, sf)
    clean = src.clean_flows(raw.withColumnRenamed("Label", "label"), "label", RAW_FEATURES, ["Flow ID"])
    return clean.select(F.col("Flow ID").alias("flow_id"),
                        *[ref(c).cast("double").alias(c) for c in RAW_FEATURES], "label")


@query("drop_dup_header", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, quantity AS quantity_text FROM flows"""))
def _(spark, sf):
    raw = scan(spark, sf)
    kept = [c for c in raw.columns if c == "quantity"]
    return raw.select(F.col("Flow ID").alias("flow_id"),
                      *[ref(c).cast("double").alias("quantity_text") for c in kept])


@query("tag_source", X.with_sql(X.FLOWS_SQL, "SELECT flow_id, day FROM flows"))
def _(spark, sf):
    _, paths = by_source(spark, raw_csv(spark, sf))
    raw = src.read_flow_csv(spark, _folders(paths))
    return src.tag_source(raw, paths).select(F.col("Flow ID").alias("flow_id"), "day")


@query("source_completeness", X.with_sql(X.EVENTS_SQL, """present AS (SELECT DISTINCT label AS name FROM events_t)""", """expected AS (SELECT concat(day, ' source') AS source, 0 AS place, concat(max(label), '?') AS name FROM events_t GROUP BY day
  UNION ALL SELECT concat(day, ' source'), 1, CASE WHEN day < '2024-01-16' THEN max(label) ELSE min(day) END FROM events_t GROUP BY day)""", """
SELECT e.source, min(p.name) AS name FROM expected e LEFT JOIN present p ON e.name = p.name GROUP BY e.source"""))
def _(spark, sf):
    t = X.events(spark, sf)
    per_day = t.groupBy("day").agg(F.max("label").alias("label"))
    second = F.when(F.col("day") < "2024-01-16", F.col("label")).otherwise(F.col("day"))
    expected = per_day.select(F.concat(F.col("day"), F.lit(" source")).alias("source"), F.inline(F.array(
        F.struct(F.lit(0).alias("place"), F.concat(F.col("label"), F.lit("?")).alias("name")),
        F.struct(F.lit(1).alias("place"), second.alias("name")))))
    return audit.complete_sources(expected, t.select(F.col("label").alias("name")))


@query("source_check", X.with_sql(X.FLOWS_SQL, """
SELECT day AS source, true AS found, true AS has_bytes FROM flows GROUP BY day UNION ALL SELECT 'absent', false, NULL"""))
def _(spark, sf):
    path = raw_csv(spark, sf)
    names, _ = by_source(spark, path)
    expected = {source: (files[0], source + "-renamed.csv") for source, files in names.items()}
    expected["absent"] = ("absent.csv", "absent-renamed.csv")
    return src.source_check(spark, expected, path).select(
        "source", F.col("name").isNotNull().alias("found"), (F.col("mb") > 0).alias("has_bytes"))


@query("sink_parquet", X.with_sql(X.FLOWS_SQL, "SELECT * FROM flows"))
def _(spark, sf):
    return spark.read.parquet(src.write_clean(X.flows(spark, sf), scratch_path(spark, "clean")))


@query("sink_stats")
def _(spark, sf):
    csv = raw_csv(spark, sf)
    parquet = src.write_clean(X.flows(spark, sf), scratch_path(spark, "clean"))
    return src.size_summary(spark, csv, parquet)


@query("take_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    chosen = X.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return take_rows(X.table(spark, sf, "lineitem"), chosen, ["l_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("stable_row_ids", "SELECT count(*) AS rows, count(*) AS distinct_ids FROM lineitem")
def _(spark, sf):
    t = with_stable_id(X.table(spark, sf, "lineitem"))
    return t.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("distinct_ids"))


@query("runs_roundtrip", X.with_sql(X.RUNS_SQL, "SELECT * FROM runs"))
def _(spark, sf):
    t = X.runs(spark, sf)
    path = results.write_runs(t, scratch_path(spark, "runs"))
    return results.read_runs(spark, path, schema=t.schema)


@query("summary_tables", X.with_sql(X.RUNS_SQL, """
SELECT 'by_model' AS sheet, model AS key, round(avg(macro_f1), 6) AS value FROM runs GROUP BY model
UNION ALL SELECT 'by_sample', sample, round(avg(macro_f1), 6) FROM runs GROUP BY sample"""))
def _(spark, sf):
    t = X.runs(spark, sf)
    tables = {f"by_{c}": t.groupBy(F.col(c).alias("key")).agg(F.round(F.avg("macro_f1"), 6).alias("value"))
              for c in ("model", "sample")}
    paths = results.write_summary_tables(tables, scratch_path(spark, "tables"))
    frames = [spark.read.parquet(p).withColumn("sheet", F.lit(n)) for n, p in paths.items()]
    return frames[0].unionByName(frames[1])
