"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Mirrors the driver's gate: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=6):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, (pd.Timestamp, _dt.datetime, _dt.date)):
        return str(v)[:10] if not getattr(v, "hour", 0) else str(v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def canon(pdf: pd.DataFrame, digits=6):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(v, digits) for v in rec))
    rows.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, rows


def compare(sdf, con, sql: str, digits=6):
    a = sdf.toPandas()
    b = con.execute(sql).df()
    ca, ra = canon(a, digits)
    cb, rb = canon(b, digits)
    if ca != cb:
        return False, f"columns differ: spark={ca} oracle={cb}"
    if len(ra) != len(rb):
        return False, f"rows differ: spark={len(ra)} oracle={len(rb)}"
    for x, y in zip(ra, rb):
        if x != y:
            return False, f"first diff: spark={x} oracle={y}"
    return True, f"{len(ra)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from tallyframe.session import build_session
    spark = build_session("local[8]")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                n = df.count()
                ok, msg = True, f"{n} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name:28s} {time.time()-t0:6.2f}s {msg}", flush=True)
    print(f"{len(names or qs) - bad} pass, {bad} fail")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
