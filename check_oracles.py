"""Run registered queries beside their SQL and compare: ``python check_oracles.py [dir] [names]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from recordflow.plans import ORACLES, QUERIES
from recordflow.schemas import INPUT_DDL

DEFAULT_DIR = "/root/testdata/sf0.01"


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, con, folder, name):
    """None when equal, else what differs."""
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return None
    rel = con.sql(ORACLES[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        return (f"{sum(got.values())} rows against {sum(want.values())}; only here "
                f"{list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}")
    types = dict(zip(rel.columns, map(str, rel.types)))
    size = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    odd = [(c, k, types[c]) for c, k in df.dtypes if size.get(k, types[c]) != types[c]]
    return ("TYPES " + str(odd)) if odd else None


def connect(folder):
    con = duckdb.connect()
    for t in INPUT_DDL:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main(argv):
    folder = argv[0] if argv else DEFAULT_DIR
    names = argv[1:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{name:28} {time.time() - start:6.2f}s "
              f"{problem or ('ok' if name in ORACLES else 'ok (no sql)')}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
