"""Run registered queries on Spark and their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return None
        return ("f", float(v) + 0.0)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(cell(x) for x in v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql: str, folder: str) -> tuple[bool, str]:
    t0 = time.time()
    df = build(spark, folder)
    got = df.collect()
    t1 = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.2f}s, duck {t2 - t1:.2f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}; {note}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, note
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{note}; {sorted(df.columns)}\n   spark only {sum((a - b).values())}: {only_a}\n   duck only {sum((b - a).values())}: {only_b}"


def main(argv):
    from terrafold.session import get_session
    from __spark_entry__ import oracle_sql, queries

    folder = argv[0]
    spark = get_session(
        "oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    qs, sqls = queries(), oracle_sql()
    wanted = argv[1:] or list(qs)
    bad = 0
    for name in wanted:
        try:
            if name not in sqls:
                t0 = time.time()
                n = qs[name](spark, folder).count()
                print(f"no-sql {name}: {n} rows {time.time() - t0:.2f}s", flush=True)
                continue
            ok, note = compare(spark, con, qs[name], sqls[name], folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok    ' if ok else 'FAIL  '} {name}: {note}", flush=True)
    print(f"{len(wanted)} checked, {bad} failed")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
