"""DataFrame operators on hand-made frames (FIXTURES §2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.operators import bins as BN
from ridelens.operators import clean as C
from ridelens.operators import common as CM
from ridelens.operators import geo as G
from ridelens.operators import profile as PF
from ridelens.operators import time as TM
from ridelens.plans import reports as R


def test_value_counts_keeps_null_group_and_ties(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",), ("b",), ("c",)], "v string")
    out = [tuple(r) for r in CM.order_by_count(CM.value_counts(df, "v"), "n", "v").collect()]
    assert out == [("b", 2), (None, 2), ("a", 1), ("c", 1)]
    dropped = CM.value_counts(df, "v", dropna=True).collect()
    assert all(r.v is not None for r in dropped)


def test_share_sums_to_100_and_empty_total(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("y",)] * 5, "v string")
    s = CM.with_share(CM.value_counts(df, "v"), "n", 1).collect()
    assert abs(sum(r.pct for r in s) - 100.0) < 1e-9
    empty = spark.createDataFrame([], "v string")
    assert CM.with_share(CM.value_counts(empty, "v"), "n", 1).count() == 0


def test_percentiles_p95_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    r = CM.exact_percentiles(df, "x", {"p95": 0.95, "med": 0.5}).first()
    assert abs(r.p95 - 3.85) < 1e-12 and r.med == 2.5


def test_percentiles_grouped_with_hot_key(spark):
    rows = [("hot", float(i % 7)) for i in range(3000)] + [("cold", 1.0), ("cold", 3.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    r = {x.k: x.med for x in CM.exact_percentiles(df, "x", {"med": 0.5}, by="k").collect()}
    import statistics

    assert r["cold"] == 2.0
    assert r["hot"] == statistics.median([float(i % 7) for i in range(3000)])


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "v string")
    assert CM.mode_of(df, "v").first()["mode"] == "a"
    allnull = spark.createDataFrame([(None,)], "v string")
    assert CM.mode_of(allnull, "v").first()["mode"] is None


def test_binned_counts_zero_bins_and_share(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (12.0,), (-3.0,)], "x double")
    out = BN.binned_counts(df, "x", BN.VALUE_USD_EDGES, BN.VALUE_USD_LABELS).orderBy("bin_idx").collect()
    assert [r.n for r in out] == [2, 0, 1, 0, 0]
    # the -3 row counts in the denominator only (4 rows)
    assert out[0].pct == 50.0 and out[2].pct == 25.0


def test_joint_histogram_used_bins_zero_cells(spark):
    # used x bins {0,1}, used y bins {0,1}; only (0,0) and (1,1) occupied
    df = spark.createDataFrame([(1.0, 1.0), (7.0, 7.0)], "x double, y double")
    out = BN.joint_histogram(df, "x", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS, "y", BN.VTAT_EDGES,
                             BN.VTAT_LABELS).orderBy("x_idx", "y_idx").collect()
    assert [(r.x_idx, r.y_idx, r.n) for r in out] == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)]
    # joint marginals equal per-bin counts
    s = BN.binned_summary(df, "x", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS, {}).collect()
    assert sorted(r.n for r in s) == [1, 1]


def test_binned_summary_used_bins_only(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (40.0, 6.0), (-1.0, 1.0)], "d double, v double")
    out = BN.binned_summary(df, "d", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS, {"avg_v": ("v", 1)}).orderBy(
        "bin_idx").collect()
    assert [(r.bin_idx, r.n, r.avg_v) for r in out] == [(0, 2, 3.0), (5, 1, 6.0)]
    assert abs(out[0].pct - 66.7) < 1e-9


def test_equi_width_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    out = BN.equi_width_histogram(df, "x", 5).orderBy("bin_idx").collect()
    assert len(out) == 5 and sum(r.n for r in out) == 11 and out[-1].n == 3


def test_trim_trailing_empty(spark):
    df = spark.createDataFrame([(0, 3), (1, 0), (2, 1), (3, 0), (4, 0)], "bin_idx int, n long")
    assert [r.bin_idx for r in BN.trim_trailing_empty(df).orderBy("bin_idx").collect()] == [0, 1, 2]


def test_box_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "x double")
    r = BN.box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3) == (2.0, 3.0, 4.0)
    assert r.whisker_high == 4.0 and r.n_outliers == 1


def test_location_lookup_cases(spark):
    locs = spark.createDataFrame(
        [("Alpha", 28.5, 77.1), ("Beta", None, None), ("Dup", 28.6, 77.2), ("DUP", 28.9, 77.9)],
        "location string, latitude double, longitude double")
    req = spark.createDataFrame([("alpha",), ("ALPHA",), ("Gamma",), ("Beta",), ("dup",), (None,)], "p string")
    lk = G.location_lookup(locs)
    out = G.geocode(req, lk, "p", "pickup", default=0.0).collect()
    got = {(r.p): (r.pickup_latitude, r.pickup_longitude) for r in out}
    assert got["alpha"] == (28.5, 77.1) and got["ALPHA"] == (28.5, 77.1)
    assert got["Gamma"] == (0.0, 0.0) and got["Beta"] == (0.0, 0.0) and got[None] == (0.0, 0.0)
    # duplicate lower-cased name: deterministic pick (smallest name "DUP")
    assert got["dup"] == (28.9, 77.9)
    keep_null = G.geocode(req, lk, "p", "pickup").where(F.col("p") == "Gamma").first()
    assert keep_null.pickup_latitude is None


def test_weekday_rebase_rules(spark):
    all17 = spark.createDataFrame([(v,) for v in [1, 2, 7, 7]], "weekday int")
    assert sorted(r.weekday for r in TM.normalize_weekday(all17).collect()) == [0, 1, 6, 6]
    zero6 = spark.createDataFrame([(v,) for v in [0, 1, 6]], "weekday int")
    assert sorted(r.weekday for r in TM.normalize_weekday(zero6).collect()) == [0, 1, 6]
    only7 = spark.createDataFrame([(7,), (7,)], "weekday int")
    assert [r.weekday for r in TM.normalize_weekday(only7, rule="no_valid").collect()] == [6, 6]
    hours24 = spark.createDataFrame([(24,), (24,)], "hour int")
    assert [r.hour for r in TM.normalize_hour(hours24).collect()] == [0, 0]
    mixed = spark.createDataFrame([(24,), (3,)], "hour int")
    assert sorted(r.hour for r in TM.normalize_hour(mixed).collect()) == [3, 24]


def test_demand_kpis_lowest_hour_on_tie(spark):
    df = spark.createDataFrame([(h, 0, 1) for h in [5, 5, 3, 3, 9]], "hour int, weekday int, month int")
    r = TM.demand_kpis(df).first()
    assert r.busiest_hour == 3 and r.busiest_n == 2


def test_heatmap_zero_fills_every_cell(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (6, 23)], "weekday int, hour int")
    rows = TM.heatmap_weekday_hour(df).orderBy("weekday").collect()
    assert len(rows) == 7
    assert rows[0].h01 == 2 and rows[6].h23 == 1 and rows[3].h05 == 0


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert PF.duplicate_count(df).first().n_duplicates == 1


def test_correlation_pairwise_deletion(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, None, 2.0), (4.0, 8.0, 4.0)],
                               "a double, b double, c double")
    out = {(r.col_a, r.col_b): r.corr for r in PF.correlation(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")] == 1.0
    import numpy as np

    assert abs(out[("a", "c")] - np.corrcoef([2.0, 3.0, 4.0], [1.0, 2.0, 4.0])[0, 1]) < 1e-6


def test_profile_and_missing(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, s string")
    p = {r.column_name: r for r in PF.profile(df).collect()}
    assert (p["x"].non_null, p["x"].n_unique, p["x"].dtype) == (3, 2, "int")
    assert (p["s"].non_null, p["s"].n_unique, p["s"].total) == (2, 2, 3)
    m = {r.column_name: r for r in PF.missing_report(df).collect()}
    assert m["s"].missing_n == 1 and abs(m["s"].missing_pct - 33.3333) < 1e-9


def test_ratings_distribution_exact_values(spark):
    df = spark.createDataFrame([(-1.0, 5.0), (1.0, 4.3), (3.0, -1.0), (4.3, 1.0), (5.0, 5.0)],
                               "driver_rating double, customer_rating double")
    d = {(r.type, r.rating): r.n for r in R.ratings_distribution(df).collect()}
    assert d[("Driver", 1)] == 1 and d[("Driver", 4)] == 0 and d[("Driver", 5)] == 1
    assert d[("Customer", 5)] == 2 and sum(d.values()) == 6
    k = R.ratings_kpis(df).first()
    assert k.driver_unrated_pct == 20.0 and abs(k.driver_avg - (1 + 3 + 4.3 + 5) / 4) <= 0.0051
    low = R.low_rating_share(df).first()
    assert low.driver_le3_pct == 50.0


def test_feedback_validation(spark):
    rows = [(3, "great ride", "a@b.co"), (2, "  ", "a@b.co"), (4, "ok", " "), (5, "ok", "a@b"), (9, " hi ", "x@y.org ")]
    df = spark.createDataFrame(rows, "rating int, message string, email string")
    valid, rejected = C.validate_feedback(df)
    v = valid.orderBy("rating").collect()
    assert [(r.rating, r.message, r.email) for r in v] == [(3, "great ride", "a@b.co"), (5, "hi", "x@y.org")]
    reasons = sorted(r.reason for r in rejected.collect())
    assert reasons == ["invalid email", "missing email", "missing message"]


def test_clean_bookings_from_raw(spark):
    from ridelens.schemas import CLEAN_COLUMNS

    raw = spark.createDataFrame(
        [("2024-03-04", "07:15:00", "B1", "Completed", "C1", "Auto", "X", "Y", None, None, None, None, None,
          None, None, None, 100.0, 4.0, None, 5.0, None, 7)],
        "Date string, Time string, `Booking ID` string, `Booking Status` string, `Customer ID` string, "
        "`Vehicle Type` string, `Pickup Location` string, `Drop Location` string, `Avg VTAT` double, "
        "`Avg CTAT` double, `Cancelled Rides by Customer` double, `Reason for cancelling by Customer` string, "
        "`Cancelled Rides by Driver` double, `Driver Cancellation Reason` string, `Incomplete Rides` double, "
        "`Incomplete Rides Reason` string, `Booking Value` double, `Ride Distance` double, "
        "`Driver Ratings` double, `Customer Rating` double, `Payment Method` string, `Unnamed: 0` int")
    r = C.clean_bookings(raw).first()
    assert list(r.asDict()) == CLEAN_COLUMNS
    assert (r.month, r.day, r.weekday, r.hour) == (3, 4, 0, 7)
    assert r.avg_vtat == 0.0 and r.driver_rating == -1.0 and r.payment_method == "No payment"
    assert r.reason_for_cancelling_by_customer is None


def test_region_subset_and_share(spark):
    from ridelens.plans.q_region import region
    from ridelens.sources.driver_views import bookings_clean

    sf = "/root/testdata/sf0.001"
    reg = region(spark, sf)
    clean = bookings_clean(spark, sf)
    assert reg.count() <= clean.count()
    assert reg.join(clean, "booking_id", "left_anti").count() == 0
    s = G.region_share(clean, reg).first()
    assert s.total_region == reg.count()


def test_bracket_percentiles_large_groups_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    hot = rng.gamma(2.0, 3.0, 20000)  # one hot group, continuous values
    cold = rng.normal(50, 5, 900)
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("tiny", 1.0), ("tiny", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    # accuracy=100 → groups of ≥ 400 rows take the approximate-bracket path
    got = {r.k: r for r in CM.exact_percentiles(df, "x", probs, by="k", accuracy=100).collect()}
    for k, arr in (("hot", hot), ("cold", cold), ("tiny", np.array([1.0, 2.0]))):
        for name, p in probs.items():
            assert abs(got[k][name] - np.quantile(arr, p)) < 1e-9, (k, name)
    g = CM.exact_percentiles(df.where("k = 'hot'"), "x", {"p50": 0.5}, accuracy=100).first()
    assert abs(g.p50 - np.quantile(hot, 0.5)) < 1e-9


def test_column_helpers(spark):
    import pytest

    df = spark.createDataFrame([(1, 100.0, -1.0, None)], "`Booking ID` int, `Booking Value` double, "
                                                        "driver_rating double, Reason string")
    assert C.resolve_column(df, ["booking_value", "Booking Value"]) == "Booking Value"
    assert C.resolve_column(df, ["reason"]) == "Reason"
    assert C.resolve_column(df, ["nope"]) is None
    with pytest.raises(ValueError):
        C.require_columns(df, ["Booking ID", "missing_col"])
    with pytest.raises(ValueError):
        C.drop_columns(df, ["missing_col"], strict=True)
    assert C.drop_columns(df, ["missing_col"]).columns == df.columns
    std = C.standardize_columns(df)
    assert "booking_id" in std.columns and "booking_value" in std.columns
    r = C.to_usd(std, "booking_value").first()
    assert abs(r.booking_value - 1.1) < 1e-12
    cat = C.null_as_category(df, ["Reason"]).first()
    assert cat.Reason == "nan"
    fl = C.with_unrated_flags(df.withColumn("customer_rating", F.lit(None).cast("double"))).first()
    assert fl.driver_unrated is True and fl.customer_unrated is False
    shown = C.display_names(std, {"booking_value": "Booking value (USD)"})
    assert "Booking value (USD)" in shown.columns


def test_strict_time_parsing_raises(spark):
    import pytest

    from ridelens.functions import hour_of_time_text

    df = spark.createDataFrame([("07:15:00",), ("bad",)], "t string")
    assert [r.h for r in df.select(hour_of_time_text("t").alias("h")).collect()] == [7, None]
    if spark.conf.get("spark.sql.ansi.enabled") == "true":
        with pytest.raises(Exception):
            df.select(hour_of_time_text("t", strict=True).alias("h")).collect()


def test_nan_never_counts_as_a_value(spark):
    df = spark.createDataFrame([(float("nan"), 3), (2.0, 4), (None, 5)], "avg_vtat double, hour int")
    assert C.valid_amount(df, "avg_vtat").count() == 1
    r = R.service_quality(df).first()
    assert r.n == 1 and r.median_vtat == 2.0


def test_auto_accuracy_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    xs = rng.exponential(5.0, 3000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert CM.auto_accuracy(df) == 10_000  # floor of the clamp for a small table
    assert CM.auto_accuracy(df, window_rows=1) == 12_000  # 4·3000/1, above the 10⁴ floor
    r = CM.exact_percentiles(df, "x", {"p90": 0.9}, accuracy="auto").first()
    assert abs(r.p90 - np.quantile(xs, 0.9)) < 1e-9
