"""Compare registered queries with their SQL on DuckDB: `python tests/oracle_check.py [names…]`."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir=SF_DIR):
    from balsam.plans.registry import BASE_TABLES

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    data = [tuple(norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return cols, sorted(data, key=repr)


def compare(spark, con, name, sf_dir=SF_DIR):
    """None when equal, else a description of the first difference."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    types = dict(df.dtypes)
    got = [tuple(r) for r in df.collect()]
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    mine = sorted([tuple(norm(r[i]) for i in order) for r in got], key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows and no oracle", len(mine), False
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    theirs = sorted([tuple(norm(r[i]) for i in oorder) for r in cur.fetchall()], key=repr)
    if sorted(cols) != sorted(ocols):
        return f"columns {sorted(cols)} != {sorted(ocols)}", len(mine), True
    if len(mine) != len(theirs):
        extra = list(set(mine) - set(theirs))[:2]
        lost = list(set(theirs) - set(mine))[:2]
        return f"{len(mine)} rows != {len(theirs)}; extra {extra}; missing {lost}", len(mine), True
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} != {b} types {types}", len(mine), True
    return ("0 rows", 0, True) if not mine else (None, len(mine), True)


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark, con = session(), duck()
    names = sys.argv[1:] or list(entry.queries())
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff, count, has = compare(spark, con, n)
        except Exception as e:  # report and go on
            diff, count, has = f"{type(e).__name__}: {str(e)[:1500]}", 0, True
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {n} rows={count} oracle={has} "
              f"{time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{len(names)} queries, {bad} failures")
