"""Runs a query in Spark and its SQL in DuckDB and compares both as bags of rows."""

import datetime
import decimal
import math
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool, bytes)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return str(value)


def kind(value):
    return "n" if isinstance(value, (int, float)) and not isinstance(value, bool) else "o"


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf, name, build, sql, con):
    """Returns (problem or None, rows, spark seconds, sql seconds)."""
    start = time.time()
    df = build(spark, sf)
    rows = df.collect()
    took = time.time() - start
    columns, ours = bag(df.columns, rows)
    if sql is None:
        return None, len(rows), took, 0.0
    start = time.time()
    cursor = con.execute(sql)
    their_columns = [d[0] for d in cursor.description]
    theirs_rows = cursor.fetchall()
    sql_took = time.time() - start
    their_columns, theirs = bag(their_columns, theirs_rows)
    if columns != their_columns:
        return f"columns {columns} != {their_columns}", len(rows), took, sql_took
    if sum(ours.values()) != sum(theirs.values()):
        return f"rows {sum(ours.values())} != {sum(theirs.values())}; only spark {list((ours - theirs).items())[:2]} only sql {list((theirs - ours).items())[:2]}", len(rows), took, sql_took
    if ours != theirs:
        gone, extra = list((theirs - ours).items()), list((ours - theirs).items())
        return f"{len(extra)} rows differ, spark {extra[:3]} sql {gone[:3]}", len(rows), took, sql_took
    if not rows:
        return "no rows", 0, took, sql_took
    return None, len(rows), took, sql_took
