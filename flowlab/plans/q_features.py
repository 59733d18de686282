"""Feature studies: medians, separability, signatures, importance, kernels, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import importance, neighbors, quantiles, reduce, runs, sampling, separability
from flowlab.plans import fixtures as X
from flowlab.plans.q_metrics import rounded, tallies_sql
from flowlab.plans.registry import query

SIDE = "CASE WHEN label = 'BENIGN' THEN 'base' ELSE 'other' END"


def long_sql(source, extra, features, name="long"):
    """SQL twin of the long form: extra columns, feature, value."""
    return f"{name} AS (" + "\nUNION ALL ".join(
        f"SELECT {extra}, '{f}' AS feature, {f} AS value FROM {source}" for f in features) + ")"


MEDIAN_TABLE_SQL = X.with_sql(X.FLOWS_SQL, long_sql("flows", f"{SIDE} AS \"group\"", X.FLOW_FEATURES), """
SELECT "group", feature, median(value) AS median FROM long GROUP BY 1, 2""")


@query("group_medians", MEDIAN_TABLE_SQL)
def _(spark, sf):
    return separability.group_median_table(X.flows(spark, sf), "label", X.FLOW_FEATURES, X.BENIGN)


# The way of large tables: histograms level by level instead of all values of a group.
@query("group_medians_levels", MEDIAN_TABLE_SQL)
def _(spark, sf):
    return quantiles.group_medians(X.flows(spark, sf).withColumn("side", F.expr(SIDE)), X.FLOW_FEATURES, "side", rows_per_bucket=0)


def auc_sql(source):
    """SQL twin of the single-feature AUC over ``source``(label, feature, value), ties half."""
    return f"""seen AS (SELECT label, feature, value, count(*) AS n FROM {source} WHERE value IS NOT NULL GROUP BY ALL)""", """
base AS (SELECT feature, value, n, sum(n) OVER (PARTITION BY feature ORDER BY value) AS upto,
    sum(n) OVER (PARTITION BY feature) AS total, min(value) OVER (PARTITION BY feature) AS low,
    max(value) OVER (PARTITION BY feature) AS high FROM seen WHERE label = 'BENIGN')""", """
others AS (SELECT s.label AS class, s.feature, s.n, s.value,
    CASE WHEN b.value = s.value THEN 2 * b.upto - b.n ELSE 2 * coalesce(b.upto, 0) END AS twice
  FROM (SELECT * FROM seen WHERE label <> 'BENIGN') s ASOF LEFT JOIN base b ON s.feature = b.feature AND s.value >= b.value)""", """
edges AS (SELECT DISTINCT feature, total, low, high FROM base)""", """
auc AS (SELECT class, o.feature, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * twice) AS DOUBLE) / 2 / sum(n) / max(total) AS auc
  FROM others o JOIN edges e ON o.feature = e.feature GROUP BY class, o.feature
  HAVING least(min(o.value), min(low)) < greatest(max(o.value), max(high)))"""


@query("feature_auc", X.with_sql(X.FLOWS_SQL, long_sql("flows", "label", X.FLOW_FEATURES), *auc_sql("long"), """
SELECT class, feature, n, round(auc, 6) AS auc, round(abs(auc - 0.5) * 2, 6) AS separation FROM auc"""))
def _(spark, sf):
    return rounded(separability.feature_auc(X.flows(spark, sf), "label", X.FLOW_FEATURES, X.BENIGN),
                   ["auc", "separation"])


def signatures_sql(source):
    """SQL twin of the class signatures over ``source``."""
    medians = "medians AS (SELECT " + ", ".join(f"median({f}) AS {f}" for f in X.FLOW_FEATURES) + f" FROM {source} WHERE label = 'BENIGN')"
    filled = "filled AS (SELECT label, " + ", ".join(
        f"coalesce(c.{f}, m.{f}) AS {f}" for f in X.FLOW_FEATURES) + f" FROM {source} c, medians m)"
    return medians, filled, long_sql("filled", "label", X.FLOW_FEATURES), *auc_sql("long"), """
ranked AS (SELECT *, abs(auc - 0.5) * 2 AS separation, row_number() OVER (PARTITION BY class
    ORDER BY abs(auc - 0.5) * 2 DESC, feature DESC, auc DESC) AS rank FROM auc)""", """
mid AS (SELECT label, feature, median(value) AS median FROM long GROUP BY 1, 2)""", """
SELECT class, CAST(rank AS INTEGER) AS rank, r.feature, round(separation, 3) AS separation,
  CASE WHEN auc > 0.5 THEN 'higher' ELSE 'lower' END AS class_is, a.median AS median_class, b.median AS median_base, n
FROM ranked r JOIN mid a ON a.label = r.class AND a.feature = r.feature
  JOIN mid b ON b.label = 'BENIGN' AND b.feature = r.feature WHERE rank <= 5"""


@query("signatures", X.with_sql(X.FLOWS_SQL, *signatures_sql("flows")))
def _(spark, sf):
    return separability.signatures(X.flows(spark, sf), "label", ["flow_id"], X.FLOW_FEATURES, X.BENIGN)


# Against a sample of the base class; all other rows count.
@query("signatures_base_sample", X.with_sql(X.FLOWS_SQL, """capped AS (SELECT * FROM (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '0', flow_id))) AS place FROM flows)
  WHERE label <> 'BENIGN' OR place <= 3000)""", *signatures_sql("capped")))
def _(spark, sf):
    return separability.signatures(X.flows(spark, sf), "label", ["flow_id"], X.FLOW_FEATURES, X.BENIGN, base_cap=3000)


SHUFFLED = ["quantity", "price", "discount", "tax"]
RANK_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 'stay', flow_id)), flow_id) - 1 AS place,
  count(*) OVER () AS total FROM flows)"""
STEP_SQL = "steps AS (SELECT feature, rep, [x FOR x IN range(f % n, f % n + 1000) IF gcd(x, n) = 1][1] AS factor, o % n AS shift, n " \
    "FROM (VALUES " + ", ".join(
        "('{}', {}, {}, {})".format(f, r, *importance.step_seeds(f, r)) for f in SHUFFLED for r in range(3)) + \
    ") s(feature, rep, f, o), (SELECT count(*) AS n FROM flows))"
PAIR_SQL = "pairs AS (SELECT (place * factor + shift) % n AS place, feature, rep, r.* EXCLUDE (place, total) FROM ranked r, steps)"
MOVED_SQL = "moved AS (SELECT a.label, p.feature, p.rep, " + ", ".join(
    f"CASE WHEN p.feature = '{f}' THEN p.{f} ELSE a.{f} END AS {f}" for f in SHUFFLED) + \
    " FROM pairs p JOIN ranked a USING (place))"
MOVED_SCORED_SQL = f"""rescored AS (SELECT concat(feature, '|', rep) AS run, feature, label, {X.RULE_SQL} AS prediction FROM moved)"""


def _importance(spark, sf):
    rows = X.flows(spark, sf).select("flow_id", "label", *SHUFFLED)
    return importance.permutation_importance(rows, ["flow_id"], SHUFFLED, "label", X.rule, repeats=3)


def _tally_names(parts, prefix):
    import re
    return [re.sub(r"\b(tally|report|summary)\b", prefix + r"\1", p) for p in parts]


IMPORTANCE_SQL = (
    X.FLOWS_SQL, f"""firstscored AS (SELECT label, {X.RULE_SQL} AS prediction FROM flows)""",
    *_tally_names(tallies_sql("firstscored"), "base_"), RANK_SQL, STEP_SQL, PAIR_SQL, MOVED_SQL, MOVED_SCORED_SQL,
    *tallies_sql("rescored", "run"), """drops AS (SELECT split_part(run, '|', 1) AS feature,
  (SELECT macro_f1 FROM base_summary) - macro_f1 AS drop_f1 FROM summary)""", """imp AS (SELECT feature, round(avg(drop_f1), 6) AS permutation_mean,
  round(stddev_pop(drop_f1), 6) AS permutation_std FROM drops GROUP BY feature)""")


@query("permutation_importance", X.with_sql(*IMPORTANCE_SQL, "SELECT * FROM imp"))
def _(spark, sf):
    return rounded(_importance(spark, sf), ["permutation_mean", "permutation_std"])


@query("top_k_importance", X.with_sql(*IMPORTANCE_SQL, """
SELECT * FROM imp ORDER BY permutation_mean DESC, feature LIMIT 2"""))
def _(spark, sf):
    table = rounded(_importance(spark, sf), ["permutation_mean", "permutation_std"])
    return runs.top_rows(table, [F.col("permutation_mean").desc(), "feature"], 2)


# First vector of every class as landmark.
MARKS_SQL = """marks AS (SELECT id AS landmark, vector AS lv FROM vectors WHERE id IN (SELECT min(id) FROM vectors GROUP BY label))"""
DOT = "list_dot_product(CAST(vector AS DOUBLE[]), CAST(lv AS DOUBLE[]))"
GAP = "pow(list_distance(CAST(vector AS DOUBLE[]), CAST(lv AS DOUBLE[])), 2)"
KERNEL_SQL = {
    "linear": DOT, "poly": f"pow({DOT} / 64 + 1, 3)", "rbf": f"exp(-{GAP} / 64)",
    "sigmoid": f"tanh({DOT} / 64 + 1)",
    "cosine": "list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(lv AS DOUBLE[]))",
}

for _kernel, _value in KERNEL_SQL.items():
    @query(f"kernel_{_kernel}", X.with_sql(X.VECTORS_SQL, MARKS_SQL, f"""
SELECT id AS row, landmark, round({_value}, 6) AS value FROM vectors, marks"""))
    def _(spark, sf, kernel=_kernel):
        t = X.vectors(spark, sf)
        first = t.groupBy("label").agg(F.min("id").alias("id")).select("id")
        marks = t.join(first, "id", "left_semi")
        return rounded(reduce.kernel_block(t, marks, kernel), ["value"])


NEAR_SQL = X.split_sql("vectors", "id", 0.4), """near AS (
  SELECT q.id AS query, b.id AS neighbour, b.label AS carry, list_distance(CAST(q.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) AS distance,
    row_number() OVER (PARTITION BY q.id ORDER BY list_distance(CAST(q.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), b.id) AS rank
  FROM parts q, parts b WHERE NOT q.is_train AND b.is_train)"""


def _near(spark, sf):
    t = sampling.stratified_split(X.vectors(spark, sf), "label", ["id"], 0.4)
    return neighbors.knn_join(t.where("not is_train"), t.where("is_train"), 5, carry="label")


@query("knn_join", X.with_sql(X.VECTORS_SQL, *NEAR_SQL, """
SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM near WHERE rank <= 5"""))
def _(spark, sf):
    return rounded(_near(spark, sf).select("query", "neighbour", "rank", "distance"), ["distance"])


# The way of large base tables: cells around pivots.
@query("knn_join_cells", X.with_sql(X.VECTORS_SQL, *NEAR_SQL, """
SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM near WHERE rank <= 5"""))
def _(spark, sf):
    t = sampling.stratified_split(X.vectors(spark, sf), "label", ["id"], 0.4)
    near = neighbors.knn_join(t.where("not is_train"), t.where("is_train"), 5, shipped_values=0, block_rows=50)
    return rounded(near.select("query", "neighbour", "rank", "distance"), ["distance"])


@query("clf_knn", X.with_sql(X.VECTORS_SQL, *NEAR_SQL, """votes AS (
  SELECT query, carry, count(*) AS n FROM near WHERE rank <= 5 GROUP BY 1, 2)""", """
SELECT query, first(carry ORDER BY n DESC, carry) AS prediction FROM votes GROUP BY query"""))
def _(spark, sf):
    return neighbors.knn_vote(_near(spark, sf))
