"""Property tests: bins agree with pandas.cut, rounding with numpy,
counts and shares add up, axes have their length, folds cover every row once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridelens.functions import bin_index, pround
from ridelens.operators import bins as BN

SF = "/root/testdata/sf0.001"
finite = st.floats(min_value=-50, max_value=250, allow_nan=False, allow_infinity=False)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(finite, min_size=1, max_size=40))
def test_bins_match_pandas_cut(spark, xs):
    edges = BN.DISTANCE_EDGES
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r.b for r in df.select(bin_index("x", edges).alias("b")).collect()]
    want = pd.cut(pd.Series(xs, dtype="float64"), bins=edges, right=True, include_lowest=True, labels=False)
    want = [None if (isinstance(w, float) and math.isnan(w)) else int(w) for w in want]
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40),
       st.integers(min_value=0, max_value=4))
def test_pround_matches_numpy(spark, xs, d):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r.r for r in df.select(pround("x", d).alias("r")).collect()]
    want = [float(np.round(x * 10**d) / 10**d) for x in xs]
    assert got == want


def test_counts_and_shares_add_up(spark):
    from ridelens.plans import catalog
    from ridelens.sources.driver_views import bookings_clean

    qs = catalog.queries()
    n = bookings_clean(spark, SF).count()
    for name in ("status_mix", "payment_mix", "demand_hour", "demand_weekday"):
        rows = qs[name](spark, SF).collect()
        assert sum(r.n for r in rows) == n, name
        assert abs(sum(r.pct for r in rows) - 100.0) <= 0.05 * len(rows) + 1e-9, name
    vd = qs["value_distribution"](spark, SF).collect()
    assert len(vd) == len(BN.VALUE_USD_LABELS) and sum(r.n for r in vd) == n


def test_joint_marginals_equal_bin_counts(spark):
    from ridelens.plans import catalog

    qs = catalog.queries()
    joint = qs["distance_wait_joint"](spark, SF)
    marg = {r.x_idx: r.s for r in joint.groupBy("x_idx").agg(F.sum("n").alias("s")).collect()}
    bins_ = {r.bin_idx: r.n for r in qs["distance_bins"](spark, SF).collect()}
    assert marg == bins_


def test_axes_have_their_length(spark):
    from ridelens.plans import catalog

    qs = catalog.queries()
    assert qs["arpu_by_hour"](spark, SF).count() == 24
    assert qs["heatmap_weekday_hour"](spark, SF).count() == 7
    assert qs["ratings_distribution"](spark, SF).count() == 10
    assert qs["equi_width_histogram"](spark, SF).count() == 30


def test_folds_partition_the_input(spark):
    from ridelens.plans import catalog
    from ridelens.sources.driver_views import bookings_clean

    f = catalog.queries()["stratified_folds"](spark, SF)
    n = bookings_clean(spark, SF).count()
    assert f.count() == n and f.select("booking_id").distinct().count() == n
    per = f.groupBy("booking_status", "fold").count().collect()
    by_class = {}
    for r in per:
        by_class.setdefault(r.booking_status, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_class.values())


def test_clean_stream_matches_batch(spark, tmp_dir):
    import os

    from ridelens.operators.clean import clean_bookings
    from ridelens.sources.driver_views import bookings_raw
    from ridelens.streaming.feedback import clean_stream

    raw = bookings_raw(spark, SF)
    landing = os.path.join(tmp_dir, "raw_landing")
    raw.write.option("header", True).csv(landing)
    stream = clean_stream(spark, landing, fmt="csv")
    q = stream.writeStream.format("parquet").option("path", os.path.join(tmp_dir, "clean_out")) \
        .option("checkpointLocation", os.path.join(tmp_dir, "ck_clean")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(os.path.join(tmp_dir, "clean_out"))
    batch = clean_bookings(raw)
    assert got.count() == batch.count()
    key = ["booking_id", "hour", "weekday", "avg_vtat"]
    a = sorted(tuple(r) for r in got.select(F.col("booking_id").cast("long"), *key[1:]).collect())
    b = sorted(tuple(r) for r in batch.select(F.col("booking_id").cast("long"), *key[1:]).collect())
    assert a == b
