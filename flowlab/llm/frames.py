"""Spark helpers of the operators: tables in the shared folder, global positions, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.session import shared_dir


# Edges up to which one task finds all components.
ONE_TASK = 50_000


def scratch(spark, name):
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df, name):
    """Write a table once to the shared folder and read it back: later steps don't depend on
    executors that may be lost, and don't repeat the work above it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def removed(spark, *tables):
    """Delete scratch tables made by ``stored`` once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_shuffles(spark):
    """While this holds, the shuffle files of a query go as soon as its result is there: steps in between
    are stored tables, so nothing reads them again. The setting is put back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions_for(spark, at_least=1):
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def running(df, order, sums, name="running"):
    """Exclusive running sums over the whole table in the given order.

    ``sums`` maps new columns to the expressions added up. Rows are range-partitioned by ``order``,
    so that no task sees more than its range; the sums of ranges are one row each, which gives the
    offset of every range. The result is a stored table that also has ``_range``."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions_for(spark), *order).withColumn("_range", F.spark_partition_id())
    table = stored(ranged, name)
    totals = table.groupBy("_range").agg(*[F.sum(e).alias(c) for c, e in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: never larger than the number of partitions
    return (table.join(F.broadcast(offsets), "_range")
            .withColumns({c: F.coalesce(F.sum(e).over(inside), F.lit(0)) + F.col(f"_{c}") for c, e in sums.items()})
            .drop(*[f"_{c}" for c in sums]))


def _forest(batches):
    """Smallest reachable node of every node, for the edges of one task."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())],
                                     names=["node", "root"])


def components(edges):
    """Smallest reachable node of every node of an undirected graph (columns u, v, long).

    Alternating stars: neighbours are hung to the smallest node around, first for larger then for
    smaller neighbours, until nothing changes. Every round is stored, so lineage stays short. At most
    ``ONE_TASK`` edges are joined up in one task instead.
    Returns a table (node, root); nodes without edges are absent."""
    spark = edges.sparkSession
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    if edges.count() <= ONE_TASK:
        found = stored(edges.coalesce(1).mapInArrow(_forest, "node long, root long"), "roots")
        removed(spark, edges)
        return found
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v")))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = stored(small, "edges")
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(spark, edges)
        edges = after
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
