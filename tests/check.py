"""python tests/check.py SF_DIR [name ...]: compare queries with their SQL, print timings."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from flowlab.session import local_session
from oracle import compare, connect

if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            problem, rows, took, sql_took = compare(spark, sf, name, build, oracles.get(name), con)
        except Exception as error:  # report and go on with the next query
            problem, rows, took, sql_took = f"{type(error).__name__}: {str(error)[:900]}", 0, 0, 0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:<28} rows {rows:>7}  spark {took:6.2f}s  sql {sql_took:6.2f}s"
              f"{'' if name in oracles else '  (rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)
