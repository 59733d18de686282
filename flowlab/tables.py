"""Small building blocks shared by the operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table of at most this many rows may be held by the driver and broadcast.
SMALL_ROWS = 100_000
# Lanes per key on which partial arrays are added up before the driver sees them.
FAN_IN = 64


def tick(name):
    """Column name as SQL text that survives dots and blanks."""
    return "`" + name.replace("`", "``") + "`"


def ticks(names):
    return [tick(n) for n in names]


def ref(name):
    """Column reference that survives dots and blanks in names."""
    return F.col(tick(name))


def struct_of(names):
    """All columns as one struct, written as one SQL text: wide tables have hundreds."""
    return F.expr("struct(" + ", ".join(ticks(names)) + ")")


def number(value):
    """A double as SQL text."""
    return f"({float(value)!r}D)"


def settled(df, max_rows=SMALL_ROWS):
    """Evaluate ``df`` once. Within ``max_rows`` it comes back as a local table
    whose size is proven, marked for broadcast; beyond that, ``df`` itself is
    returned and Spark picks the join from its own size estimates."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def local_table(spark, rows, schema):
    """A broadcastable table from driver-side rows (already bounded)."""
    struct = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrays = [pa.array(list(c)) if c else pa.array([], pa.null()) for c in columns]
    table = pa.table(dict(zip([f.name for f in struct.fields], arrays)))
    return F.broadcast(spark.createDataFrame(table, schema=struct))


def value_of(df, *columns):
    """A one-row DataFrame as a scalar subquery; several columns give a struct."""
    if len(columns) == 1:
        return df.select(columns[0]).scalar()
    return df.select(F.struct(*columns)).scalar()


def spread(df):
    """Spread rows over all cores when they come from fewer files than there are
    cores, ahead of iterative or CPU-heavy work. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def numeric_matrix(pdf, columns):
    """Feature columns of a pandas batch as a float64 matrix, missing = NaN."""
    return pdf[columns].to_numpy(dtype=np.float64, na_value=np.nan)


def tree_sum(df, columns, batch_sums, few=False):
    """Sum named float arrays over a distributed table.

    ``batch_sums(pdf)`` turns one Arrow batch into ``{key: 1-d array}``. Every
    task adds up its own batches and ships one array per key; the partial arrays
    are then added on ``FAN_IN`` lanes per key, so neither one task nor the
    driver meets one array per input partition. The result ``{key: array}`` is
    on the driver: its size depends on keys and columns, never on the rows.
    ``few`` tells that the table has at most ``FAN_IN`` partitions: then one
    stage is enough."""
    return task_sums(df, columns, lambda batches: _add_up(batch_sums(pdf) for pdf in batches), few)


def task_sums(df, columns, run, few=False):
    """Like ``tree_sum``, with ``run(batches)`` turning all batches of a task into ``{key: 1-d array}``."""
    def first(batches):
        yield from _as_frames(run(pdf for pdf in batches if len(pdf)))

    def again(batches):
        yield from _as_frames(_add_up(
            {key: np.asarray(part, dtype=np.float64)}
            for pdf in batches for key, part in zip(pdf["key"], pdf["total"])))

    if few:
        rows = df.select(*ticks(columns)).mapInPandas(first, _PARTS).collect()
    else:
        parts = spread(df.select(*ticks(columns))).mapInPandas(first, _PARTS)
        rows = parts.repartition("lane", "key").mapInPandas(again, _PARTS).toLocalIterator()
    return _add_up({r["key"]: np.asarray(r["total"])} for r in rows)


def is_few(table):
    """Whether a table that is read from files has at most ``FAN_IN`` partitions."""
    return table.rdd.getNumPartitions() <= FAN_IN


_PARTS = "lane int, key string, total array<double>"


def _add_up(dicts):
    totals = {}
    for d in dicts:
        for key, part in d.items():
            totals[key] = totals[key] + part if key in totals else part
    return totals


def _as_frames(totals):
    context = TaskContext.get()
    lane = context.partitionId() % FAN_IN if context else 0
    for key, total in totals.items():
        yield pd.DataFrame({"lane": [lane], "key": [key], "total": [total]})


def ship(spark, model):
    """Broadcast a fitted model with its code, so that executors need no package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpack(shipped):
    return cloudpickle.loads(shipped.value)
