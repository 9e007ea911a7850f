"""Differential test: every catalogue query with an oracle SQL twin matches DuckDB
(row count, column names, values) on the smallest driver scale."""

from __future__ import annotations

import math

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _canon(df):
    import pandas as pd

    cols = sorted(df.columns)
    rows = []
    for r in df[cols].itertuples(index=False):
        row = []
        for v in r:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        rows.append(tuple(row))
    return cols, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def _names():
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ridelens.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from ridelens.plans import catalog

    s = catalog.queries()[name](spark, SF).toPandas()
    o = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert len(s) == len(o)
    sc, sr = _canon(s)
    oc, orr = _canon(o)
    assert sc == oc
    assert sr == orr
