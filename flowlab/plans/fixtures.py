"""Labelled record tables derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

FLOW_FEATURES = ["quantity", "price", "discount", "tax", "line_no", "rate", "const0", "qty_copy"]
LIVE_FEATURES = [f for f in FLOW_FEATURES if f != "const0"]
EVENT_FEATURES = ["value", "k", "user_id", "hour"]
BENIGN = "BENIGN"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flows(spark, sf):
    """lineitem as labelled records: three uneven classes, a rate with missing
    values, a constant and a copied feature; one source per shipping year."""
    t = table(spark, sf, "lineitem")
    label = (F.when((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1), "RARE")
             .when(F.col("l_quantity") >= 45, "MID").otherwise(BENIGN))
    return t.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("flow_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("line_no"),
        F.try_divide("l_extendedprice", "l_tax").alias("rate"), F.lit(0.0).alias("const0"),
        F.col("l_quantity").alias("qty_copy"), label.alias("label"),
        F.year("l_shipdate").cast("string").alias("day"))


FLOWS_SQL = """flows AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         CAST(l_linenumber AS DOUBLE) AS line_no,
         CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS rate,
         CAST(0 AS DOUBLE) AS const0, l_quantity AS qty_copy,
         CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 THEN 'RARE'
              WHEN l_quantity >= 45 THEN 'MID' ELSE 'BENIGN' END AS label,
         CAST(year(l_shipdate) AS VARCHAR) AS day
  FROM lineitem)"""


def copies(spark, sf):
    """lineitem cut down to five columns, so that exact copies abound."""
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("day"))


COPIES_SQL = """copies AS (
  SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
         l_returnflag AS label, l_linestatus AS day FROM lineitem)"""


def copies_with_id(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("flow_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("day"))


COPIES_ID_SQL = """copies AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id,
         l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
         l_returnflag AS label, l_linestatus AS day FROM lineitem)"""


def events(spark, sf):
    """events as labelled records: five even classes, one source per day."""
    t = table(spark, sf, "events")
    return t.select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("user_id").cast("double").alias("user_id"), F.hour("ts").cast("double").alias("hour"),
        F.col("event_type").alias("label"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


EVENTS_SQL = r"""events_t AS (
  SELECT event_id, value, CAST(regexp_extract(props, '"k":\s*(-?\d+)', 1) AS DOUBLE) AS k,
         CAST(user_id AS DOUBLE) AS user_id, CAST(hour(ts) AS DOUBLE) AS hour,
         event_type AS label, strftime(ts, '%Y-%m-%d') AS day FROM events)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS id, embedding AS vector, concat('c', label) AS label FROM embeddings)"""


def vector_columns(spark, sf):
    """The vectors with one column per dimension."""
    t = vectors(spark, sf)
    dims = t.select(F.max(F.size("vector"))).first()[0]
    names = [f"x{i}" for i in range(dims)]
    return t.selectExpr("id", "label", *[f"vector[{i}] AS {n}" for i, n in enumerate(names)]), names


def runs(spark, sf):
    """Orders summed up as model runs: one row per model, split and sample."""
    t = table(spark, sf, "orders")
    test = (F.when(F.col("o_orderstatus") == "F", 0.2).when(F.col("o_orderstatus") == "O", 0.4)
            .otherwise(0.6))
    sample = F.when(F.year("o_orderdate") % 3 == 0, "full").otherwise(
        (F.year("o_orderdate") * 100).cast("string"))
    return t.groupBy(F.col("o_orderpriority").alias("model"), test.alias("test_size"),
                     sample.alias("sample")).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("macro_f1"),
        F.round(F.max("o_totalprice") / 1e6, 6).alias("accuracy"),
        F.round(F.sum(F.col("o_custkey") % 7) / 10.0, 1).alias("seconds"))


RUNS_SQL = """runs AS (
  SELECT o_orderpriority AS model,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.4 ELSE 0.6 END AS DOUBLE) AS test_size,
         CASE WHEN year(o_orderdate) % 3 = 0 THEN 'full'
              ELSE CAST(year(o_orderdate) * 100 AS VARCHAR) END AS sample,
         count(*) AS n_test, round(avg(o_totalprice) / 1e6, 6) AS macro_f1,
         round(max(o_totalprice) / 1e6, 6) AS accuracy,
         round(sum(o_custkey % 7) / 10.0, 1)::DOUBLE AS seconds
  FROM orders GROUP BY 1, 2, 3)"""

KERNELS = ["linear", "poly", "rbf", "sigmoid", "cosine"]


def grid(spark, sf):
    """Orders summed up as a kernel grid: classifier x test size x kernel x components x seed."""
    t = table(spark, sf, "orders")
    test = (F.when(F.col("o_orderstatus") == "F", 0.2).when(F.col("o_orderstatus") == "O", 0.4)
            .otherwise(0.6))
    kernel = F.element_at(F.array(*[F.lit(k) for k in ["none", *KERNELS]]),
                          (F.month("o_orderdate") % 6 + 1).cast("int"))
    components = F.when(F.month("o_orderdate") % 6 == 0, 0).otherwise(
        5 * (F.dayofmonth("o_orderdate") % 3 + 1))
    return t.groupBy(
        F.col("o_orderpriority").alias("classifier"), test.alias("test_size"), kernel.alias("kernel"),
        components.cast("int").alias("components"),
        (F.year("o_orderdate") % 3).cast("int").alias("seed")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("macro_f1"),
        F.round(F.min("o_totalprice") / 1e6, 6).alias("accuracy"))


GRID_SQL = """grid AS (
  SELECT o_orderpriority AS classifier,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.4 ELSE 0.6 END AS DOUBLE) AS test_size,
         CASE month(o_orderdate) % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'linear' WHEN 2 THEN 'poly'
              WHEN 3 THEN 'rbf' WHEN 4 THEN 'sigmoid' ELSE 'cosine' END AS kernel,
         CAST(CASE WHEN month(o_orderdate) % 6 = 0 THEN 0
              ELSE 5 * (day(o_orderdate) % 3 + 1) END AS INTEGER) AS components,
         CAST(year(o_orderdate) % 3 AS INTEGER) AS seed,
         round(avg(o_totalprice) / 1e6, 6) AS macro_f1, round(min(o_totalprice) / 1e6, 6) AS accuracy
  FROM orders GROUP BY 1, 2, 3, 4, 5)"""


def rule(df):
    """A fixed threshold rule as classifier, for metrics that SQL has to repeat."""
    return df.withColumn("prediction", F.when(
        (F.col("quantity") >= 48) & (F.col("discount") >= 0.08), "RARE").when(
        F.col("quantity") >= 42, "MID").otherwise(BENIGN))


RULE_SQL = """CASE WHEN quantity >= 48 AND discount >= 0.08 THEN 'RARE'
       WHEN quantity >= 42 THEN 'MID' ELSE 'BENIGN' END"""


def quality(spark, sf):
    """Documents with a quality mark and a length rule as prediction."""
    marks = table(spark, sf, "labels")
    texts = table(spark, sf, "documents").select("doc_id", "n_chars")
    return marks.join(texts, "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("label"),
        F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("prediction"))


QUALITY_SQL = """quality_t AS (
  SELECT doc_id, CAST(quality AS VARCHAR) AS label,
         CASE WHEN n_chars > 500 THEN '1' ELSE '0' END AS prediction
  FROM labels JOIN documents USING (doc_id))"""


def split_sql(source, row_id, test_size, seed=0, name="parts"):
    """SQL twin of the stratified split: ``name`` = source plus is_train."""
    return f"""{name}_counts AS (SELECT label, count(*) AS n FROM {source} WHERE label IS NOT NULL GROUP BY label),
{name}_total AS (SELECT CAST(sum(n) AS HUGEINT) AS total,
    CAST(sum(n) - ceil(CAST(sum(n) AS DOUBLE) * CAST({test_size} AS DOUBLE)) AS HUGEINT) AS train FROM {name}_counts),
{name}_share AS (SELECT label, n, train, (n * train) // total AS base, (n * train) % total AS rest
    FROM {name}_counts, {name}_total),
{name}_quota AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
    <= train - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM {name}_share),
{name} AS (SELECT s.*, row_number() OVER (PARTITION BY s.label
    ORDER BY md5(concat_ws(':', 'split{seed}', s.{row_id}))) <= q.take AS is_train
    FROM {source} s JOIN {name}_quota q ON s.label = q.label)"""


def sample_sql(source, row_id, n, floor=50, seed=0, name="drawn"):
    """SQL twin of the stratified sample."""
    return f"""{name}_counts AS (SELECT label, count(*) AS n FROM {source} WHERE label IS NOT NULL GROUP BY label),
{name}_quota AS (SELECT label, n, least(n, greatest(
    CAST(round_even(n * (CAST({n} AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE)), 0) AS BIGINT),
    least({floor}, n))) AS take FROM {name}_counts),
{name} AS (SELECT * EXCLUDE (place, take) FROM (SELECT s.*, q.take, row_number() OVER (PARTITION BY s.label
    ORDER BY md5(concat_ws(':', '{seed}', s.{row_id}))) AS place
    FROM {source} s JOIN {name}_quota q ON s.label = q.label) WHERE place <= take)"""


def with_sql(*parts):
    """WITH a, b, ... final"""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
