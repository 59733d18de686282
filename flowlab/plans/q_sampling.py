"""Exact samples, splits, caps and shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import neighbors, prep, sampling
from flowlab.plans import fixtures as X
from flowlab.plans.registry import query


def _ids(df, *more):
    return df.select("flow_id", "label", *more)


@query("stratified_sample", X.with_sql(X.FLOWS_SQL, X.sample_sql("flows", "flow_id", 3000, 50), """
SELECT flow_id, label, price FROM drawn"""))
def _(spark, sf):
    return _ids(sampling.stratified_sample(X.flows(spark, sf), "label", ["flow_id"], 3000, 50), "price")


@query("stratified_sample_events", X.with_sql(X.EVENTS_SQL, X.sample_sql("events_t", "event_id", 777, 200, seed=3), """
SELECT event_id, label, value FROM drawn"""))
def _(spark, sf):
    return sampling.stratified_sample(X.events(spark, sf), "label", ["event_id"], 777, 200, seed=3).select(
        "event_id", "label", "value")


@query("seed_repeat_sample", X.with_sql(
    X.FLOWS_SQL, *[X.sample_sql("flows", "flow_id", 2000, 50, seed=s, name=f"drawn{s}") for s in (0, 1, 2)],
    "\nUNION ALL ".join(f"SELECT {s} AS seed, flow_id, label FROM drawn{s}" for s in (0, 1, 2))))
def _(spark, sf):
    t = X.flows(spark, sf)
    parts = [_ids(sampling.stratified_sample(t, "label", ["flow_id"], 2000, 50, seed=s)).withColumn(
        "seed", F.lit(s)) for s in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sample_quotas", X.with_sql(X.FLOWS_SQL, X.sample_sql("flows", "flow_id", 5000, 100), """
SELECT label, n, CAST(take AS BIGINT) AS take FROM drawn_quota"""))
def _(spark, sf):
    return sampling.sample_quotas(sampling.class_counts(X.flows(spark, sf), "label"), 5000, 100)


@query("cap_per_class", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '0', flow_id))) AS place
  FROM flows) WHERE place <= 1000"""))
def _(spark, sf):
    return _ids(sampling.cap_per_class(X.flows(spark, sf), "label", ["flow_id"], 1000))


@query("undersample_majority", X.with_sql(X.FLOWS_SQL, """
SELECT flow_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '0', flow_id))) AS place
  FROM flows) WHERE label <> 'BENIGN' OR place <= 9000"""))
def _(spark, sf):
    return _ids(sampling.undersample(X.flows(spark, sf), "label", ["flow_id"], X.BENIGN, 9000))


for _name, _size in (("stratified_split", 0.4), ("stratified_split_80_20", 0.2)):
    @query(_name, X.with_sql(X.FLOWS_SQL, X.split_sql("flows", "flow_id", _size), """
SELECT flow_id, label, is_train FROM parts"""))
    def _(spark, sf, size=_size):
        return _ids(sampling.stratified_split(X.flows(spark, sf), "label", ["flow_id"], size), "is_train")


@query("split_quotas", X.with_sql(X.EVENTS_SQL, X.split_sql("events_t", "event_id", 0.6), """
SELECT label, n, CAST(take AS BIGINT) AS take FROM parts_quota"""))
def _(spark, sf):
    q = sampling.split_quotas(sampling.class_counts(X.events(spark, sf), "label"), 0.6)
    return q.withColumn("take", F.col("take").cast("bigint"))


@query("permute_column", X.with_sql(X.FLOWS_SQL, """stays AS (
  SELECT flow_id, label, row_number() OVER (ORDER BY md5(concat_ws(':', 'stay', flow_id))) AS place FROM flows)""", """moves AS (
  SELECT price, row_number() OVER (ORDER BY md5(concat_ws(':', 'move0', flow_id))) AS place FROM flows)""", """
SELECT flow_id, label, price FROM stays JOIN moves USING (place)"""))
def _(spark, sf):
    return sampling.permute_column(_ids(X.flows(spark, sf), "price"), "price", ["flow_id"])


@query("class_weights", X.with_sql(X.FLOWS_SQL, """
SELECT label, count(*) AS n, round((SELECT count(*) FROM flows) / ((SELECT count(DISTINCT label) FROM flows) * count(*)), 6) AS weight
FROM flows GROUP BY label"""))
def _(spark, sf):
    return prep.class_weights(X.flows(spark, sf), "label").withColumn("weight", F.round("weight", 6))


@query("smote_targets", X.with_sql(X.FLOWS_SQL, """
SELECT label, count(*) AS n, 5000 - count(*) AS missing FROM flows GROUP BY label HAVING count(*) < 5000"""))
def _(spark, sf):
    return neighbors.smote_targets(X.flows(spark, sf), "label", 5000)


@query("smote_counts", X.with_sql(X.FLOWS_SQL, """
SELECT label, synthetic, count(*) AS n FROM (
  SELECT label, false AS synthetic FROM flows
  UNION ALL SELECT label, true FROM (SELECT label, count(*) AS n FROM flows GROUP BY label), generate_series(1, 8000 - n)
  WHERE n < 8000) GROUP BY label, synthetic"""))
def _(spark, sf):
    made = neighbors.smote(X.flows(spark, sf), "label", ["quantity", "price", "discount", "tax"], target=8000)
    return made.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


# Synthetic rows by the same draws: rows of a class numbered by their features, neighbours by distance and
# number, and the digits of md5(seed|class|counter).
FILL = ["quantity", "price", "discount", "tax"]
SMOTE_SQL = X.with_sql(
    X.FLOWS_SQL, "sizes AS (SELECT label, count(*) AS n FROM flows GROUP BY label HAVING count(*) < 5000)",
    "least AS (SELECT least(5, min(n) - 1) AS k FROM sizes)",
    f"numbered AS (SELECT label, {', '.join(FILL)}, row_number() OVER (PARTITION BY label ORDER BY {', '.join(FILL)}) - 1 AS place "
    "FROM flows JOIN sizes USING (label))",
    "near AS (SELECT a.label, a.place AS start, " + ", ".join(f"a.{f} AS x_{f}, b.{f} AS y_{f}" for f in FILL)
    + ", row_number() OVER (PARTITION BY a.label, a.place ORDER BY sqrt("
    + " + ".join(f"(b.{f} - a.{f}) * (b.{f} - a.{f})" for f in FILL)
    + "), b.place) - 1 AS pick FROM numbered a JOIN numbered b ON a.label = b.label AND a.place <> b.place)",
    "counters AS (SELECT label, n, unnest(range(5000 - n)) AS counter FROM sizes)",
    "digests AS (SELECT label, n, md5(concat_ws('|', '0', label, counter)) AS d FROM counters)",
    "draws AS (SELECT label, CAST('0x' || d[1:8] AS BIGINT) % n AS start, CAST('0x' || d[9:16] AS BIGINT) % k AS pick, "
    "CAST('0x' || d[17:24] AS BIGINT) / 4294967296.0::DOUBLE AS step FROM digests, least)",
    f"SELECT {', '.join(FILL)}, label, false AS synthetic FROM flows UNION ALL SELECT "
    + ", ".join(f"x_{f} + step * (y_{f} - x_{f})" for f in FILL) + ", label, true FROM draws JOIN near USING (label, start, pick)")


@query("smote", SMOTE_SQL)
def _(spark, sf):
    return neighbors.smote(X.flows(spark, sf), "label", ["quantity", "price", "discount", "tax"], target=5000)


@query("resample_counts", X.with_sql(X.FLOWS_SQL, """counts AS (SELECT label, count(*) AS n FROM flows GROUP BY label)""", """cut AS (SELECT label, CASE WHEN label = 'BENIGN' THEN least(n, 20000) ELSE n END AS n FROM counts)""", """
SELECT label, 'none' AS strategy, n FROM counts UNION ALL SELECT label, 'class_weight', n FROM counts
UNION ALL SELECT label, 'undersample', n FROM cut
UNION ALL SELECT label, 'smote', greatest(n, 5000) FROM counts
UNION ALL SELECT label, 'under+smote', greatest(n, 5000) FROM cut"""))
def _(spark, sf):
    return neighbors.resampled_counts(X.flows(spark, sf), "label", X.BENIGN, 20_000, 5_000)


@query("resample_rows", X.with_sql(X.FLOWS_SQL, """counts AS (SELECT label, count(*) AS n FROM flows GROUP BY label)""", """
SELECT label, greatest(CASE WHEN label = 'BENIGN' THEN least(n, 20000) ELSE n END, 5000) AS n FROM counts"""))
def _(spark, sf):
    made = neighbors.resample("under+smote", X.flows(spark, sf), "label", ["flow_id"],
                              ["quantity", "price", "discount", "tax"], X.BENIGN, 20_000, 5_000)
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
