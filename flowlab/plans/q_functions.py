"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions import scalars as S
from flowlab.operators import audit, prep
from flowlab.plans import fixtures as X
from flowlab.plans.registry import query
from flowlab.sources.flows import trim_columns
from flowlab.tables import all_of, ref


@query("trim_columns", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem""")
def _(spark, sf):
    t = X.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return trim_columns(t.toDF("  l_orderkey", "l_partkey ", " l_quantity  "))


@query("coerce_numeric", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(CASE l_linenumber
  WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN concat(l_suppkey, ' ') WHEN 4 THEN concat(l_suppkey, 'e2')
  ELSE concat(l_partkey, '.5') END AS DOUBLE) AS number FROM lineitem""")
def _(spark, sf):
    t = X.table(spark, sf, "lineitem")
    line = F.col("l_linenumber")
    text = (F.when(line == 1, "x").when(line == 2, "")
            .when(line == 3, F.concat(F.col("l_suppkey").cast("string"), F.lit(" ")))
            .when(line == 4, F.concat(F.col("l_suppkey").cast("string"), F.lit("e2")))
            .otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit(".5"))))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    S.to_number(text).alias("number"))


@query("inf_to_null", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_tax <> 0 AND l_linenumber <> 7 THEN l_extendedprice / l_tax END AS rate FROM lineitem""")
def _(spark, sf):
    t = X.table(spark, sf, "lineitem")
    raw = (F.when(F.col("l_tax") == 0, F.lit(float("inf")))
           .when(F.col("l_linenumber") == 7, F.lit(float("nan")))
           .otherwise(F.try_divide("l_extendedprice", "l_tax")))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    S.finite_or_null(raw).alias("rate"))


@query("clean_label", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E]+', '-', 'g'), '\s+', ' ', 'g')) AS label
FROM documents""")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.clean_label(F.col("text")).alias("label"))


@query("downcast_float", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, CAST(CAST(rate AS FLOAT) AS DOUBLE) AS rate FROM flows"""))
def _(spark, sf):
    small = prep.downcast(X.flows(spark, sf), ["price", "rate"])
    return small.select("flow_id", F.col("price").cast("double"), F.col("rate").cast("double"))


@query("drop_constant", X.with_sql(X.FLOWS_SQL, "SELECT * EXCLUDE (const0) FROM flows"))
def _(spark, sf):
    return audit.drop_constant(X.flows(spark, sf), X.FLOW_FEATURES)


@query("feature_projection", X.with_sql(X.FLOWS_SQL, "SELECT * EXCLUDE (flow_id, label, day) FROM flows"))
def _(spark, sf):
    return X.flows(spark, sf).select(*X.FLOW_FEATURES)


DROP_LISTS = {"all": [], "no price": ["price", "not there"], "no rate": ["rate"],
              "neither": ["price", "rate"]}


@query("ablation_sets", X.with_sql(X.FLOWS_SQL, """
SELECT 'all' AS feature_set, 8 AS n_features, count(rate) AS complete_rows FROM flows
UNION ALL SELECT 'no price', 7, count(rate) FROM flows
UNION ALL SELECT 'no rate', 7, count(*) FROM flows
UNION ALL SELECT 'neither', 6, count(*) FROM flows"""))
def _(spark, sf):
    sets = prep.ablation_sets(X.FLOW_FEATURES, DROP_LISTS)
    cells = [F.struct(F.lit(name).alias("feature_set"), F.lit(len(columns)).alias("n_features"),
                      F.count_if(all_of([ref(c).isNotNull() for c in columns])).alias("complete_rows"))
             for name, columns in sets.items()]
    return X.flows(spark, sf).agg(F.array(*cells).alias("c")).select(F.inline("c"))


@query("label_encode", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, f.label, code FROM flows f JOIN (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT label FROM flows)) c ON f.label = c.label"""))
def _(spark, sf):
    return prep.encode_label(X.flows(spark, sf).select("flow_id", "label"), "label")


@query("split_tag", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat(CAST(round((1 - l_discount) * 100) AS INTEGER), '/', CAST(round(l_discount * 100) AS INTEGER)) AS tag,
  concat(CAST(round((1 - l_discount) * 100) AS INTEGER), '_', CAST(round(l_discount * 100) AS INTEGER)) AS file_tag
FROM lineitem""")
def _(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.split_tag(F.col("l_discount")).alias("tag"), S.split_file_tag(F.col("l_discount")).alias("file_tag"))


@query("gamma_label", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN '-' WHEN l_tax = 0 THEN 'default'
  ELSE format('{:g}', l_tax) END AS gamma_label FROM lineitem""")
def _(spark, sf):
    t = X.table(spark, sf, "lineitem")
    kernel = F.when(F.col("l_returnflag") == "N", "linear").when(
        F.col("l_returnflag") == "A", "rbf").otherwise("poly")
    gamma = F.when(F.col("l_tax") != 0, F.col("l_tax"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    S.gamma_label(kernel, gamma).alias("gamma_label"))


@query("name_lookup", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low'
  ELSE o_orderpriority END AS name FROM orders""")
def _(spark, sf):
    names = {"1-URGENT": "Urgent", "5-LOW": "Low"}
    return X.table(spark, sf, "orders").select(
        "o_orderkey", S.display_name(F.col("o_orderpriority"), names).alias("name"))


@query("compact_number", r"""
SELECT o_orderkey,
  CASE WHEN v >= 1e6 THEN concat(regexp_replace(printf('%.1f', round(v / 1e6, 1)), '\.0$', ''), 'M')
       WHEN v >= 1e3 THEN concat(regexp_replace(printf('%.1f', round(v / 1e3, 1)), '\.0$', ''), 'k')
       ELSE CAST(CAST(round_even(v, 0) AS BIGINT) AS VARCHAR) END AS compact,
  CASE WHEN p >= 0.001 THEN concat(printf('%.1f', round(p * 100, 1)), '%') WHEN p > 0 THEN '<0.1%' ELSE '0%' END AS percent
FROM (SELECT o_orderkey, o_totalprice * (o_custkey % 9) / 2 AS v, (o_custkey % 50) / 20000.0::DOUBLE AS p FROM orders)""")
def _(spark, sf):
    t = X.table(spark, sf, "orders")
    return t.select("o_orderkey",
                    S.compact_number(F.col("o_totalprice") * (F.col("o_custkey") % 9) / 2).alias("compact"),
                    S.percent_text((F.col("o_custkey") % 50) / 20000.0).alias("percent"))


@query("short_class", """
SELECT p_partkey, substr(split_part(concat(p_brand, ' - ', p_type), ' - ', -1), 1, 11) AS short,
  CASE p_type WHEN 'STANDARD' THEN 'Std' ELSE p_type END AS alias FROM part""")
def _(spark, sf):
    name = F.concat(F.col("p_brand"), F.lit(" - "), F.col("p_type"))
    return X.table(spark, sf, "part").select("p_partkey", S.short_class(name).alias("short"),
                                             S.class_alias(F.col("p_type"), {"STANDARD": "Std"}).alias("alias"))


@query("run_filter", X.with_sql(X.RUNS_SQL, """
SELECT * FROM runs WHERE test_size = 0.4 AND sample <> 'full' AND starts_with(model, '1')
  OR (sample = 'full' AND macro_f1 > 0.25)"""))
def _(spark, sf):
    chosen = (S.split_tag(F.col("test_size")) == "60/40") & (F.col("sample") != "full") & F.col(
        "model").startswith("1")
    return X.runs(spark, sf).where(chosen | ((F.col("sample") == "full") & (F.col("macro_f1") > 0.25)))


@query("throughput", """
SELECT o_orderkey, CAST(CASE WHEN s > 0 THEN floor(o_totalprice / s) ELSE 0 END AS BIGINT) AS per_second
FROM (SELECT *, (o_custkey % 10) / 4.0::DOUBLE AS s FROM orders)""")
def _(spark, sf):
    seconds = (F.col("o_custkey") % 10) / 4.0
    return X.table(spark, sf, "orders").select(
        "o_orderkey", S.safe_rate(F.col("o_totalprice"), seconds).alias("per_second"))


@query("run_label", X.with_sql(X.RUNS_SQL, """
SELECT concat(model, '  /  ', sample) AS row_label, concat('Kernel PCA (', model, ')') AS method,
  CASE WHEN macro_f1 > 0.25 THEN 'higher' ELSE 'lower' END AS direction, macro_f1 FROM runs"""))
def _(spark, sf):
    return X.runs(spark, sf).select(
        S.joined_label("model", "sample").alias("row_label"),
        F.format_string("Kernel PCA (%s)", "model").alias("method"),
        S.direction(F.col("macro_f1") + 0.25).alias("direction"), "macro_f1")


@query("assign_rename", X.with_sql(X.GRID_SQL, """
SELECT classifier, test_size, kernel, CASE WHEN components = 0 THEN 'all' ELSE CAST(components AS VARCHAR) END AS components,
  macro_f1 - accuracy AS margin FROM grid"""))
def _(spark, sf):
    g = X.grid(spark, sf).withColumns({
        "margin": F.col("macro_f1") - F.col("accuracy"),
        "components": F.when(F.col("components") == 0, "all").otherwise(F.col("components").cast("string"))})
    return g.drop("macro_f1", "accuracy", "seed")
