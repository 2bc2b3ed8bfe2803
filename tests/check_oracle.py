"""Compare registered queries with their SQL counterparts; also a command line tool.

    python tests/check_oracle.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    got = [tuple(plain(row[c]) for c in names) for row in frame.collect()]
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(c) for c in names]
    want = [tuple(plain(row[i]) for i in order) for row in result.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got.sort(key=repr)
    want.sort(key=repr)
    for a, b in zip(got, want):
        if a != b:
            wrong = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"first difference {wrong} in\n  {a}\n  {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as contract
    from questline.session import build_session

    session = build_session(master="local[8]", spark_ui_enabled="false", spark_sql_shuffle_partitions="8",
                            spark_driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    database = connect(folder)
    known, sqls = contract.queries(), contract.oracle_sql()
    for key in sys.argv[2:] or known:
        start = time.time()
        if key not in sqls:
            print(key, "rows only", known[key](session, folder).count())
            continue
        try:
            found = compare(session, database, known[key], sqls[key], folder)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:700]}"
        print(key, "ok" if found is None else "WRONG " + found[:1500], f"{time.time() - start:.1f}s", flush=True)
