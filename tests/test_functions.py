"""Column builders: bins, rounding, parsing, formatting (FIXTURES §2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.functions import (
    bin_index,
    bin_label,
    clip,
    min_sec,
    month_to_num,
    parse_hour,
    parse_weekday,
    pround,
    strip_ws,
    to_number,
)
from ridelens.operators.bins import VALUE_USD_EDGES, VALUE_USD_LABELS


def test_right_closed_bins(spark):
    vals = [(-1.0,), (0.0,), (5.0,), (5.01,), (10.0,), (20.0,), (21.0,), (None,)]
    df = spark.createDataFrame(vals, "x double")
    out = df.select(bin_index("x", VALUE_USD_EDGES).alias("b")).collect()
    assert [r.b for r in out] == [None, 0, 0, 1, 1, 3, 4, None]
    lab = df.select(bin_label(bin_index("x", VALUE_USD_EDGES), VALUE_USD_LABELS).alias("l")).collect()
    assert lab[1].l == "$0–5" and lab[6].l == ">$20" and lab[0].l is None


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (3.5,), (-2.5,)], "x double")
    r = df.select(pround("x", 2).alias("a"), pround("x", 0).alias("b")).collect()
    assert r[0].a == 0.12
    assert [x.b for x in r[1:]] == [2.0, 4.0, -2.0]


def test_to_number_and_clip(spark):
    df = spark.createDataFrame([("7",), ("x",), ("NaN",), (None,), ("30",)], "s string")
    r = df.select(to_number("s").alias("n"), clip(to_number("s"), 0, 23).alias("c")).collect()
    assert [x.n for x in r] == [7.0, None, None, None, 30.0]
    assert [x.c for x in r] == [7.0, None, None, None, 23.0]


def test_parse_weekday_text(spark):
    df = spark.createDataFrame([("Mon",), (" friday ",), ("3",), ("xx",), (None,), ("SUNDAY",)], "w string")
    assert [r.w for r in df.select(parse_weekday("w").alias("w")).collect()] == [0, 4, 3, None, None, 6]
    assert [r.w for r in df.select(parse_weekday("w", unknown=0).alias("w")).collect()] == [0, 4, 3, 0, 0, 6]


def test_parse_hour_text(spark):
    df = spark.createDataFrame([("7",), ("07:00",), ("7 pm",), ("xx",), ("24",), (None,), ("12 am",)], "h string")
    assert [r.h for r in df.select(parse_hour("h").alias("h")).collect()] == [7, 7, 19, None, 24, None, 0]


def test_month_names(spark):
    df = spark.createDataFrame([(" March ",), ("DECEMBER",), ("Mar",), (None,)], "m string")
    assert [r.m for r in df.select(month_to_num("m").alias("m")).collect()] == [3, 12, None, None]


def test_min_sec_label(spark):
    df = spark.createDataFrame([(4.5,), (0.5,), (-1.0,), (None,), (10.0125,)], "m double")
    ms = min_sec("m")
    r = df.select(ms["minutes"].alias("a"), ms["seconds"].alias("b"), ms["label"].alias("c")).collect()
    assert (r[0].a, r[0].b, r[0].c) == (4, 30, "4 min 30 sec")
    assert r[1].c == "30 sec"
    assert r[2].c == "0 sec"
    assert r[3].c is None and r[3].a is None
    assert r[4].c == "10 min 01 sec"


def test_strip_ws(spark):
    df = spark.createDataFrame([("  a b \n",), ("\t",)], "s string")
    assert [r.s for r in df.select(strip_ws("s").alias("s")).collect()] == ["a b", ""]


def test_no_python_udfs_in_report_plans(spark):
    from ridelens.plans import catalog

    for name in ["value_distribution", "heatmap_weekday_hour", "zone_kpis", "stratified_folds"]:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_lit_helper_is_jvm_side(spark):
    from ridelens.operators.common import axis_frame

    df = axis_frame(spark, "h", [0, 1, 2], ["a", "b", "c"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
    assert [tuple(r) for r in df.orderBy("h").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert df.where(F.col("h") == 1).count() == 1


def test_text_formatters(spark):
    from ridelens.functions import fmt_currency, fmt_pct, fmt_thousands, stars

    df = spark.createDataFrame([(12345.678, 61.95, 4.6), (0.5, 0.04, None)], "v double, p double, r double")
    r = df.select(fmt_thousands("v").alias("a"), fmt_currency("v").alias("b"), fmt_pct("p").alias("c"),
                  stars("r").alias("d")).collect()
    assert (r[0].a, r[0].b, r[0].c, r[0].d) == ("12,346", "$12,345.68", "62.0%", "★★★★★")
    assert r[1].d is None and r[1].b == "$0.50"
