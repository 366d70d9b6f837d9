"""Run registered queries and their SQL side by side.

`python tests/compare.py [--sf DIR] [name ...]` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from abacist import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, otherwise a short account of the difference."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(mine)
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", len(mine)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}", len(mine)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else None), len(mine)


def main(argv):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir, argv = argv[i + 1], argv[:i] + argv[i + 2 :]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            diff, rows = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            diff, rows = f"{type(e).__name__}: {str(e)[:700]}", -1
        mark = "FAIL" if diff else ("ok  " if name in oracles else "rows")
        failed += bool(diff)
        print(f"{mark} {name} {time.time() - start:.1f}s rows={rows} {diff or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
