"""Run-table analytics on runs and grids summed up from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import runs
from flowlab.plans import fixtures as X
from flowlab.plans.q_metrics import rounded
from flowlab.plans.registry import query

SPLITS = [0.2, 0.4, 0.6]


@query("runs_todo", X.with_sql(X.RUNS_SQL, """done AS (SELECT DISTINCT model, test_size FROM runs WHERE test_size = 0.2 AND model < '3'),
plan AS (SELECT DISTINCT a.model, b.test_size, c.sample FROM runs a, runs b, runs c)""", """
SELECT model, test_size, sample FROM plan p WHERE NOT EXISTS (
  SELECT 1 FROM done d WHERE d.model = p.model AND d.test_size = p.test_size)"""))
def _(spark, sf):
    t = X.runs(spark, sf)
    axes = t.agg(*[F.collect_set(c).alias(c) for c in ("model", "test_size", "sample")])
    return runs.runs_todo(runs.full_grid(axes), t.where("test_size = 0.2 and model < '3'"), ["model", "test_size"])


@query("runs_upsert", X.with_sql(X.RUNS_SQL, """fresh AS (SELECT model, test_size, sample, macro_f1 + 1 AS macro_f1 FROM runs WHERE test_size > 0.3
  UNION ALL SELECT concat(model, '+'), test_size, sample, macro_f1 FROM runs WHERE sample = 'full')""", """
SELECT model, test_size, sample, round(macro_f1, 6) AS macro_f1 FROM fresh
UNION ALL SELECT model, test_size, sample, macro_f1 FROM runs r WHERE NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.model = r.model AND f.test_size = r.test_size AND f.sample = r.sample)"""))
def _(spark, sf):
    t = X.runs(spark, sf).select("model", "test_size", "sample", "macro_f1")
    fresh = t.where("test_size > 0.3").withColumn("macro_f1", F.col("macro_f1") + 1).unionByName(
        t.where("sample = 'full'").withColumn("model", F.concat("model", F.lit("+"))))
    return rounded(runs.upsert_runs(t, fresh, ["model", "test_size", "sample"]), ["macro_f1"])


@query("union_drift", X.with_sql(X.GRID_SQL, """
SELECT classifier, kernel, NULL::DOUBLE AS accuracy, macro_f1, NULL::INTEGER AS seed FROM grid WHERE seed = 0
UNION ALL SELECT classifier, kernel, accuracy, macro_f1, seed FROM grid WHERE seed > 0"""))
def _(spark, sf):
    g = X.grid(spark, sf)
    old = g.where("seed = 0").select("classifier", "kernel", "macro_f1")
    new = g.where("seed > 0").select("seed", "classifier", "kernel", "accuracy", "macro_f1")
    return runs.union_drift([old, new])


GRID_AXES_SQL = """axis AS (SELECT DISTINCT o_orderpriority AS classifier FROM orders), test AS (SELECT DISTINCT test_size FROM grid),
comp AS (SELECT DISTINCT components FROM grid), kern AS (SELECT DISTINCT kernel FROM grid WHERE kernel <> 'none'),
gam AS (SELECT DISTINCT CASE WHEN l_tax > 0 THEN l_tax END AS gamma FROM lineitem)"""


def _grid_axes(spark, sf):
    g = X.grid(spark, sf)
    axes = g.agg(F.collect_set("classifier").alias("classifier"), F.collect_set("test_size").alias("test_size"),
                 F.collect_set("components").alias("components"),
                 F.collect_set(F.when(F.col("kernel") != "none", F.col("kernel"))).alias("kernel"))
    tax = X.table(spark, sf, "lineitem").select("l_tax").distinct()
    gamma = tax.agg(F.collect_list(F.struct(F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("g"))).alias("s"))
    return axes.withColumn("gamma", gamma.select(F.transform("s", lambda x: x["g"])).scalar())


@query("grid_plan", X.with_sql(X.GRID_SQL, GRID_AXES_SQL, """
SELECT DISTINCT classifier, test_size, components, CASE WHEN components > 0 THEN kernel ELSE 'none' END AS kernel,
  CASE WHEN components > 0 AND kernel IN ('poly', 'rbf', 'sigmoid') THEN gamma END AS gamma,
  CASE WHEN components = 0 OR kernel IN ('linear', 'cosine') THEN '-' WHEN gamma IS NULL THEN 'default'
       ELSE format('{:g}', gamma) END AS gamma_label
FROM axis, test, comp, kern, gam"""))
def _(spark, sf):
    return runs.grid_plan(_grid_axes(spark, sf))


@query("grid_plan_75", X.with_sql(X.GRID_SQL, GRID_AXES_SQL, """
SELECT classifier, test_size, kernel, concat('Test_', test_size, '_DR_', kernel, '_', classifier) AS script FROM axis, test, kern"""))
def _(spark, sf):
    plan = runs.full_grid(_grid_axes(spark, sf).select("classifier", "test_size", "kernel"))
    return plan.withColumn("script", F.concat(
        F.lit("Test_"), F.col("test_size").cast("string"), F.lit("_DR_"), "kernel", F.lit("_"), "classifier"))


PIVOT_SQL = ", ".join(f"round(avg(CASE WHEN test_size = {v} THEN macro_f1 END), 6) AS \"{v}\"" for v in SPLITS)
KERNEL_PIVOT_SQL = ", ".join(f"round(avg(CASE WHEN kernel = '{k}' THEN macro_f1 END), 4) AS {k}" for k in X.KERNELS)


@query("pivot_metric", X.with_sql(X.RUNS_SQL, f"SELECT model, {PIVOT_SQL} FROM runs GROUP BY model"))
def _(spark, sf):
    return runs.pivot_metric(X.runs(spark, sf), ["model"], "test_size", SPLITS, "macro_f1", digits=6)


@query("pivot_fixed_order", X.with_sql(X.GRID_SQL, f"""
SELECT classifier, {KERNEL_PIVOT_SQL}, CAST(NULL AS DOUBLE) AS "not there" FROM grid GROUP BY classifier"""))
def _(spark, sf):
    return runs.pivot_metric(X.grid(spark, sf), ["classifier"], "kernel", [*X.KERNELS, "not there"],
                             "macro_f1", digits=4)


@query("complete_pivot", X.with_sql(X.RUNS_SQL, """wide AS (SELECT concat(model, ' ', sample) AS run, avg(CASE WHEN test_size = 0.2 THEN macro_f1 END) AS a,
  avg(CASE WHEN test_size = 0.4 THEN macro_f1 END) AS b, avg(CASE WHEN test_size = 0.6 AND model < '4' THEN macro_f1 END) AS c FROM runs GROUP BY 1)""", """
SELECT run, a AS "0.2", b AS "0.4", c AS "0.6", round((a + b + c) / 3, 6) AS mean, least(a, b, c) AS lowest,
  greatest(a, b, c) AS highest, round(greatest(a, b, c) - least(a, b, c), 6) AS span FROM wide WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""))
def _(spark, sf):
    # some runs have no score yet, so that some rows of the pivot are incomplete
    t = X.runs(spark, sf).withColumn("macro_f1", F.expr("if(test_size < 0.5 or model < '4', macro_f1, null)")).withColumn(
        "run", F.concat_ws(" ", "model", "sample"))
    return rounded(runs.complete_pivot(t, ["run"], "test_size", SPLITS, "macro_f1"), ["mean", "span"])


@query("pivot_delta", X.with_sql(X.GRID_SQL, """
SELECT classifier, round(avg(CASE WHEN kernel = 'linear' THEN macro_f1 END), 6) AS base,
  round(avg(CASE WHEN kernel = 'rbf' THEN macro_f1 END), 6) AS other,
  round(avg(CASE WHEN kernel = 'rbf' THEN macro_f1 END) - avg(CASE WHEN kernel = 'linear' THEN macro_f1 END), 6) AS delta
FROM grid GROUP BY classifier"""))
def _(spark, sf):
    return rounded(runs.pivot_delta(X.grid(spark, sf), ["classifier"], "kernel", "linear", "rbf", "macro_f1"),
                   ["base", "other", "delta"])


@query("best_per_group", X.with_sql(X.GRID_SQL, """
SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY classifier, seed
  ORDER BY macro_f1 DESC, kernel, components, test_size) AS place FROM grid WHERE components > 0) WHERE place = 1"""))
def _(spark, sf):
    return runs.best_reduced(X.grid(spark, sf), by=("classifier", "seed"))


BEST_SQL = """reduced AS (SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY macro_f1 DESC, kernel, components, test_size) AS place
  FROM grid WHERE components > 0)""", """base AS (SELECT classifier, test_size, max(macro_f1) AS baseline FROM grid WHERE components = 0 GROUP BY 1, 2)"""


@query("best_vs_baseline", X.with_sql(X.GRID_SQL, *BEST_SQL, """
SELECT r.classifier, r.test_size, kernel, components, macro_f1 AS best, baseline
FROM reduced r JOIN base b ON r.classifier = b.classifier AND r.test_size = b.test_size WHERE place = 1"""))
def _(spark, sf):
    return runs.best_vs_baseline(X.grid(spark, sf))


@query("kpca_gain_same_split", X.with_sql(X.GRID_SQL, *BEST_SQL, """
SELECT r.classifier, r.test_size, kernel, components, macro_f1 AS best, baseline, round(macro_f1 - baseline, 6) AS gain
FROM reduced r JOIN base b ON r.classifier = b.classifier AND r.test_size = b.test_size WHERE place = 1"""))
def _(spark, sf):
    return rounded(runs.gain_same_split(X.grid(spark, sf)), ["gain"])


@query("kpca_gain_max", X.with_sql(X.GRID_SQL, """
SELECT classifier, max(CASE WHEN components > 0 THEN macro_f1 END) AS best, max(CASE WHEN components = 0 THEN macro_f1 END) AS baseline,
  round(max(CASE WHEN components > 0 THEN macro_f1 END) - max(CASE WHEN components = 0 THEN macro_f1 END), 6) AS gain
FROM grid GROUP BY classifier"""))
def _(spark, sf):
    return rounded(runs.gain_of_best(X.grid(spark, sf)), ["gain"])


@query("kpca_gain_mean", X.with_sql(X.GRID_SQL, *BEST_SQL, """
SELECT r.classifier, kernel, components, test_size, macro_f1 AS best, round(b.baseline, 6) AS baseline, round(macro_f1 - b.baseline, 6) AS gain
FROM reduced r LEFT JOIN (SELECT classifier, avg(macro_f1) AS baseline FROM grid WHERE components = 0 GROUP BY 1) b
  ON r.classifier = b.classifier WHERE place = 1"""))
def _(spark, sf):
    return rounded(runs.gain_over_mean(X.grid(spark, sf)), ["baseline", "gain"])


@query("gain_stability", X.with_sql(X.GRID_SQL, """gains AS (SELECT classifier, seed, max(CASE WHEN components > 0 THEN macro_f1 END)
  - max(CASE WHEN components = 0 THEN macro_f1 END) AS gain FROM grid GROUP BY 1, 2)""", """
SELECT classifier, count(gain) AS samples, round(avg(gain), 6) AS mean_gain, min(sign(gain)) = max(sign(gain)) AS same_sign
FROM gains GROUP BY classifier"""))
def _(spark, sf):
    gains = runs.gain_of_best(X.grid(spark, sf), by=("classifier", "seed"))
    return rounded(runs.gain_stability(gains), ["mean_gain"])


@query("pick_protocol", X.with_sql(X.RUNS_SQL, """best AS (SELECT sample FROM runs GROUP BY sample
  ORDER BY count(*) DESC, (sample = 'full') DESC, sample LIMIT 1)""", """
SELECT runs.*, CASE WHEN sample = 'full' THEN 'Full dataset' ELSE concat(format('{:,}', TRY_CAST(sample AS BIGINT)), '-flow stratified sample') END AS protocol
FROM runs WHERE sample = (SELECT sample FROM best)"""))
def _(spark, sf):
    return runs.pick_protocol(X.runs(spark, sf))


@query("pick_protocol_sample", X.with_sql(X.RUNS_SQL, """r AS (SELECT * REPLACE (CASE WHEN sample = 'full' AND test_size <> 0.4 THEN '100' ELSE sample END AS sample) FROM runs)""", """best AS (SELECT sample FROM r GROUP BY sample
  ORDER BY count(*) DESC, (sample = 'full') DESC, sample LIMIT 1)""", """
SELECT r.*, CASE WHEN sample = 'full' THEN 'Full dataset' ELSE concat(format('{:,}', TRY_CAST(sample AS BIGINT)), '-flow stratified sample') END AS protocol
FROM r WHERE sample = (SELECT sample FROM best)"""))
def _(spark, sf):
    # most runs on all rows count as runs on a sample, so that a sample wins
    return runs.pick_protocol(X.runs(spark, sf).withColumn(
        "sample", F.expr("if(sample = 'full' and test_size <> 0.4, '100', sample)")))


@query("count_distinct_param", X.with_sql(X.GRID_SQL, """
SELECT classifier, components, count(DISTINCT CASE WHEN kernel <> 'none' THEN kernel END) AS settings, count(*) AS runs,
  count(DISTINCT CASE WHEN kernel <> 'none' THEN kernel END) > 1 AS tuned FROM grid GROUP BY 1, 2"""))
def _(spark, sf):
    return runs.parameter_counts(X.grid(spark, sf), ["classifier", "components"], "kernel", unset="none")


@query("custom_order", X.with_sql(X.GRID_SQL, """
SELECT *, CAST(list_position(['none', 'linear', 'poly', 'rbf', 'sigmoid', 'cosine'], kernel) - 1 AS INTEGER) AS kernel_rank,
  CAST(list_position(['5-LOW', '1-URGENT'], classifier) - 1 AS INTEGER) AS classifier_rank FROM grid"""))
def _(spark, sf):
    return runs.custom_order(X.grid(spark, sf), {"kernel": ["none", *X.KERNELS],
                                                 "classifier": ["5-LOW", "1-URGENT"]})


@query("pick_list_top", X.with_sql(X.GRID_SQL, """
SELECT * EXCLUDE (rn), CAST(list_position(['3-MEDIUM', '1-URGENT', 'not there'], classifier) - 1 AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY macro_f1 DESC, test_size, kernel, components, seed) AS rn FROM grid
  WHERE classifier IN ('3-MEDIUM', '1-URGENT')) WHERE rn = 1"""))
def _(spark, sf):
    return runs.pick_list_top(X.grid(spark, sf), "classifier", ["3-MEDIUM", "1-URGENT", "not there"],
                              [F.col("macro_f1").desc(), "test_size", "kernel", "components", "seed"])


@query("top_runs", X.with_sql(X.GRID_SQL, """
SELECT * FROM grid ORDER BY macro_f1 DESC, classifier, test_size, kernel, components, seed LIMIT 15"""))
def _(spark, sf):
    return runs.top_rows(X.grid(spark, sf), [F.col("macro_f1").desc(), "classifier", "test_size", "kernel",
                                             "components", "seed"], 15)


@query("compare_methods", X.with_sql(X.GRID_SQL, """named AS (SELECT classifier, concat('Kernel PCA (', kernel, ')') AS method, macro_f1 FROM grid WHERE components > 0
  UNION ALL SELECT classifier, 'none', macro_f1 FROM grid WHERE components = 0)""", """
SELECT classifier, """ + ", ".join(f"round(avg(CASE WHEN method = '{m}' THEN macro_f1 END), 4) AS \"{m}\"" for m in
       ["none", *[f"Kernel PCA ({k})" for k in X.KERNELS]]) + " FROM named GROUP BY classifier"))
def _(spark, sf):
    g = X.grid(spark, sf)
    named = runs.relabelled(g.where("components > 0").withColumn("method", F.col("kernel")), "method", "Kernel PCA (%s)")
    both = named.unionByName(g.where("components = 0").withColumn("method", F.lit("none")))
    return runs.pivot_metric(both, ["classifier"], "method", ["none", *[f"Kernel PCA ({k})" for k in X.KERNELS]],
                             "macro_f1", digits=4)


SHEET_SQL = f"""one AS (SELECT * FROM grid WHERE components = 15 AND seed = 0)"""
NAMES = {"1-URGENT": "Urgent (sheet #1)", "5-LOW": "Low (sheet #5)"}


@query("sheet_75", X.with_sql(X.GRID_SQL, SHEET_SQL, """
SELECT 'best' AS sheet, classifier, concat(kernel, ' ', test_size) AS key, macro_f1 AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY macro_f1 DESC, test_size, kernel) AS rn FROM one) WHERE rn = 1
UNION ALL SELECT 'kernel_by_classifier', classifier, kernel, round(avg(macro_f1), 4) FROM one GROUP BY classifier, kernel
UNION ALL SELECT 'runs', classifier, concat(kernel, ' ', test_size), macro_f1 FROM one"""))
def _(spark, sf):
    one = X.grid(spark, sf).where("components = 15 and seed = 0")
    sheets = runs.sheet_tables(one, X.KERNELS, sorted(NAMES), NAMES)
    key = F.concat_ws(" ", "kernel", F.col("test_size").cast("string")).alias("key")
    best = sheets["best"].select(F.lit("best").alias("sheet"), "classifier", key, F.col("macro_f1").alias("value"))
    wide = sheets["kernel_by_classifier"].unpivot(["classifier"], X.KERNELS, "key", "value").where(
        "value is not null").select(F.lit("kernel_by_classifier").alias("sheet"), "classifier", "key", "value")
    rows = sheets["runs"].select(F.lit("runs").alias("sheet"), "classifier", key, F.col("macro_f1").alias("value"))
    return best.unionByName(wide).unionByName(rows)


@query("chart_components_mean", X.with_sql(X.GRID_SQL, "SELECT classifier, " + ", ".join(
    f"round(avg(CASE WHEN components = {c} THEN macro_f1 END), 6) AS \"{c}\"" for c in (5, 10, 15, 0)) + " FROM grid GROUP BY classifier"))
def _(spark, sf):
    return runs.pivot_metric(X.grid(spark, sf), ["classifier"], "components", [5, 10, 15, 0], "macro_f1", digits=6)


@query("chart_accuracy_vs_macro_f1", X.with_sql(X.RUNS_SQL, """
SELECT model, macro_f1, accuracy, CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS place
FROM runs WHERE test_size = 0.4 AND sample = (
  SELECT sample FROM runs GROUP BY sample ORDER BY count(*) DESC, (sample = 'full') DESC, sample LIMIT 1)"""))
def _(spark, sf):
    from pyspark.sql import Window

    chosen = runs.pick_protocol(X.runs(spark, sf)).where("test_size = 0.4")
    order = Window.partitionBy().orderBy(F.col("macro_f1").desc(), "model")  # one row per model
    return chosen.select("model", "macro_f1", "accuracy", F.row_number().over(order).alias("place"))


@query("chart_throughput", X.with_sql(X.RUNS_SQL, """
SELECT model, CAST(CASE WHEN seconds > 0 THEN floor(n_test / seconds) ELSE 0 END AS BIGINT) AS flows_per_sec
FROM runs WHERE test_size = 0.4 AND sample = 'full'"""))
def _(spark, sf):
    from flowlab.functions.scalars import safe_rate

    chosen = X.runs(spark, sf).where("test_size = 0.4 and sample = 'full'")
    return chosen.select("model", safe_rate(F.col("n_test"), F.col("seconds")).alias("flows_per_sec"))


@query("chart_strategy_best", X.with_sql(X.RUNS_SQL, """
SELECT model, sample AS strategy, round(avg(macro_f1), 6) AS macro_f1,
  round(avg(macro_f1), 6) = max(round(avg(macro_f1), 6)) OVER (PARTITION BY model) AS is_best FROM runs GROUP BY model, sample"""))
def _(spark, sf):
    from pyspark.sql import Window

    means = X.runs(spark, sf).groupBy("model", F.col("sample").alias("strategy")).agg(
        F.round(F.avg("macro_f1"), 6).alias("macro_f1"))
    top = F.max("macro_f1").over(Window.partitionBy("model"))  # one row per strategy
    return means.withColumn("is_best", F.col("macro_f1") == top)
