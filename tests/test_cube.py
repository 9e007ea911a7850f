"""Reports give the same on counted rows as on the rows themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ridelens.operators import common as CM
from ridelens.plans import cube as CU
from ridelens.plans import persisted as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return P.build_tables(spark, SF)


COUNTED = sorted(n for n, (key, _) in P.REPORTS.items() if "/" in key)


@pytest.mark.parametrize("name", COUNTED)
def test_report_on_counted_rows(tables, name):
    key, fn = P.REPORTS[name]
    own, full = fn(tables[key]), fn(tables[key.split("/")[0]])
    assert own.dtypes == full.dtypes
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)


def test_slices_stand_for_all_rows(tables):
    for key, slices in (("clean", CU.CLEAN_SLICES), ("region", CU.REGION_SLICES)):
        n = tables[key].count()
        for s, cols in slices.items():
            t = tables[f"{key}/{s}"]
            assert t.agg(F.sum(CM.ROWS)).first()[0] == n
            assert t.count() == t.select(*cols).distinct().count()


def test_null_keys_are_not_totals(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "x"), (None, None)], "k string, m string")
    cells = CU.counted(df, {"k": ["k"], "m": ["m"]})
    got = {s: sorted(map(tuple, CU.slice_of(cells, {"k": ["k"], "m": ["m"]}, s).collect()), key=repr) for s in "km"}
    assert got == {"k": [("a", 2), (None, 2)], "m": [("x", 1), (None, 3)]}


def test_one_pass_over_the_rows(tables):
    plan = CU.counted(tables["region"], CU.REGION_SLICES, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
