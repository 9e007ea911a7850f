"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [--sf DIR] [name ...]
Prints one line per query: rows, schema (column names) and exact / approximate
value equality (order-insensitive).
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in r))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def _approx_eq(a, b):
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if x is None or y is None:
                if x is not y and not (x is None and y is None):
                    return False
                continue
            if isinstance(x, float) or isinstance(y, float):
                if not math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9):
                    return False
            elif x != y:
                return False
    return True


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    import duckdb
    import pandas as pd

    from ridelens.plans import catalog
    from ridelens.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs = catalog.queries()
    sqls = catalog.oracle_sql()
    names = a.names or list(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, a.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = sqls.get(name)
        if sql is None:
            print(f"{name:32s} rows={len(sdf):6d} (no oracle) spark={ts:.1f}s")
            continue
        try:
            odf = con.execute(sql).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SQL-ERROR {str(e)[:400]}")
            bad += 1
            continue
        stypes = {f.name: f.dataType.simpleString() for f in qs[name](spark, a.sf).schema.fields}
        otypes = dict(zip(con.sql(sql).columns, [str(t) for t in con.sql(sql).types]))
        tmap = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
                "BOOLEAN": "boolean", "FLOAT": "float", "DATE": "date", "HUGEINT": "hugeint"}
        tdiff = {c: (stypes.get(c), otypes.get(c)) for c in stypes
                 if tmap.get(otypes.get(c, ""), otypes.get(c)) != stypes.get(c)}
        sc, sr = _rows(sdf)
        oc, orr = _rows(odf)
        same_cols = sc == oc
        exact = same_cols and sr == orr
        approx = same_cols and _approx_eq(sr, orr)
        status = "OK" if exact else ("APPROX" if approx else "MISMATCH")
        if status != "OK":
            bad += 1
        print(f"{name:32s} {status:8s} rows s={len(sdf)} o={len(odf)} cols_eq={same_cols} spark={ts:.1f}s"
              + (f" TYPES {tdiff}" if tdiff else ""))
        if status != "OK" or a.show:
            if not same_cols:
                print("   spark cols:", sc)
                print("   sql   cols:", oc)
            else:
                with pd.option_context("display.max_columns", 30, "display.width", 250):
                    diffs = [(x, y) for x, y in zip(sr, orr) if x != y][:5]
                    for x, y in diffs:
                        print("   S:", x)
                        print("   O:", y)
    print(f"done: {len(names)} queries, {bad} not OK")


if __name__ == "__main__":
    main()
