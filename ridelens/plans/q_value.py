"""Booking value, status and vehicle reports (R2, R3, R4) over the bookings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.functions import pround
from ridelens.operators import bins as B
from ridelens.plans import reports as R
from ridelens.plans.oracle_views import with_views
from ridelens.plans.registry import register
from ridelens.plans.sqltext import case_bins, flag, label_table, pr, share
from ridelens.sources.driver_views import bookings, bookings_clean, table

_USD = "booking_value * CAST(0.011 AS DOUBLE)"

# ---------------------------------------------------------------------------
# R2 booking value
# ---------------------------------------------------------------------------
_VALUE_DIST_SQL = with_views(
    f"""
SELECT s.bin_idx, s.label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
       {pr("CAST(COALESCE(c.n, 0) AS DOUBLE) / greatest(CAST((SELECT count(*) FROM v) AS DOUBLE), 1.0) * 100.0", 2)} AS pct
FROM s LEFT JOIN c ON s.bin_idx = c.bin_idx
""",
    f"""
v AS (SELECT {_USD} AS x FROM B_clean WHERE booking_value >= 0),
{label_table("s", B.VALUE_USD_LABELS)},
c AS (SELECT {case_bins("x", B.VALUE_USD_EDGES)} AS bin_idx, count(*) AS n FROM v GROUP BY 1)
""",
)


@register("value_distribution", _VALUE_DIST_SQL)
def value_distribution(spark, sf):
    return R.value_distribution(bookings_clean(spark, sf))


_ORDER_VALUE_SQL = with_views(
    f"""
SELECT s.bin_idx, s.label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
       {pr("CAST(COALESCE(c.n, 0) AS DOUBLE) / greatest(CAST((SELECT count(*) FROM v) AS DOUBLE), 1.0) * 100.0", 2)} AS pct
FROM s LEFT JOIN c ON s.bin_idx = c.bin_idx
""",
    f"""
v AS (SELECT o_totalprice * CAST(0.011 AS DOUBLE) AS x FROM orders WHERE o_totalprice >= 0),
{label_table("s", B.VALUE_USD_LABELS)},
c AS (SELECT {case_bins("x", B.VALUE_USD_EDGES)} AS bin_idx, count(*) AS n FROM v GROUP BY 1)
""",
)


@register("order_value_distribution", _ORDER_VALUE_SQL)
def order_value_distribution(spark, sf):
    """Same USD histogram over every order's total price (INR)."""
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("booking_value"))
    return R.value_distribution(o)


_VALUE_KPIS_SQL = with_views(
    f"""
SELECT CAST(count(*) AS BIGINT) AS n, {pr("avg(usd)", 4)} AS avg_usd, {pr("median(usd)", 4)} AS median_usd,
       {pr("CAST(count(*) FILTER (WHERE usd <= 5) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE) * 100.0", 2)} AS pct_0_5
FROM v
""",
    f"v AS (SELECT {_USD} AS usd FROM B_clean WHERE booking_value >= 0)",
)


@register("value_kpis", _VALUE_KPIS_SQL)
def value_kpis(spark, sf):
    return R.value_kpis(bookings_clean(spark, sf))


_VALUE_TAIL_SQL = with_views(
    f"""
SELECT {pr("sum(pct) FILTER (WHERE bin_idx >= 2)", 2)} AS tail_pct,
       CAST(sum(n) FILTER (WHERE bin_idx >= 2) AS BIGINT) AS tail_n
FROM d
""",
    f"""
v AS (SELECT {_USD} AS x FROM B_clean WHERE booking_value >= 0),
{label_table("s", B.VALUE_USD_LABELS)},
c AS (SELECT {case_bins("x", B.VALUE_USD_EDGES)} AS bin_idx, count(*) AS n FROM v GROUP BY 1),
d AS (SELECT s.bin_idx, COALESCE(c.n, 0) AS n,
             {pr("CAST(COALESCE(c.n, 0) AS DOUBLE) / greatest(CAST((SELECT count(*) FROM v) AS DOUBLE), 1.0) * 100.0", 2)} AS pct
      FROM s LEFT JOIN c ON s.bin_idx = c.bin_idx)
""",
)


@register("tail_share", _VALUE_TAIL_SQL)
def tail_share(spark, sf):
    return R.value_tail(bookings_clean(spark, sf))


# ---------------------------------------------------------------------------
# R3 booking status
# ---------------------------------------------------------------------------
_STATUS_SQL = with_views(
    f"SELECT booking_status, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct FROM c",
    "c AS (SELECT booking_status, count(*) AS n FROM B_clean GROUP BY 1)",
)


@register("status_mix", _STATUS_SQL)
def status_mix(spark, sf):
    return R.status_mix(bookings_clean(spark, sf))


_STATUS_TOTAL_SQL = with_views(
    """
SELECT o_orderstatus, CAST(n AS BIGINT) AS n, pct, is_total FROM s
UNION ALL
SELECT 'Total', CAST(sum(n) AS BIGINT), """ + pr("sum(pct)", 1) + """, true FROM s
""",
    f"""
c AS (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1),
s AS (SELECT o_orderstatus, n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct, false AS is_total FROM c)
""",
)


@register("status_mix_total", _STATUS_TOTAL_SQL)
def status_mix_total(spark, sf):
    return R.counts_with_total(table(spark, sf, "orders"), "o_orderstatus")


def _pct_sql(name: str) -> str:
    return f"COALESCE(arg_max(pct, n) FILTER (WHERE lower(booking_status) = '{name.lower()}'), 0.0)"


_FRICTION_SQL = with_views(
    f"""
SELECT total_rides, completion_pct, cancel_customer_pct, cancel_driver_pct, no_driver_pct, incomplete_pct,
       {pr("cancel_customer_pct + cancel_driver_pct + no_driver_pct", 1)} AS total_friction_pct,
       {pr("cancel_raw", 1)} AS cancel_pct,
       CAST(round_even(total_rides * CAST(0.01 AS DOUBLE), 0) AS BIGINT) AS plus1pp_rides,
       CASE WHEN cancel_customer_pct >= cancel_driver_pct AND cancel_customer_pct >= no_driver_pct
                 THEN 'Customer cancellations'
            WHEN cancel_driver_pct >= no_driver_pct THEN 'Driver cancellations'
            ELSE 'No driver found' END AS top_friction,
       greatest(cancel_customer_pct, cancel_driver_pct, no_driver_pct) AS top_friction_pct
FROM k
""",
    f"""
c AS (SELECT booking_status, count(*) AS n FROM B_clean GROUP BY 1),
s AS (SELECT booking_status, n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct FROM c),
k AS (SELECT CAST(sum(n) AS BIGINT) AS total_rides,
             {_pct_sql("Completed")} AS completion_pct,
             {_pct_sql("Cancelled by Customer")} AS cancel_customer_pct,
             {_pct_sql("Cancelled by Driver")} AS cancel_driver_pct,
             {_pct_sql("No Driver Found")} AS no_driver_pct,
             {_pct_sql("Incomplete")} AS incomplete_pct,
             COALESCE(sum(pct) FILTER (WHERE lower(booking_status) LIKE '%cancel%'), 0.0) AS cancel_raw
      FROM s)
""",
)


@register("friction_report", _FRICTION_SQL)
def friction_report(spark, sf):
    return R.friction_report(bookings_clean(spark, sf))


def _reasons_sql(col: str) -> str:
    return with_views(
        f"""
SELECT {col} AS reason, CAST(count(*) AS BIGINT) AS n FROM B_clean WHERE {col} IS NOT NULL
GROUP BY 1 ORDER BY n DESC, reason ASC LIMIT 5
"""
    )


@register("top_reasons_customer", _reasons_sql("reason_for_cancelling_by_customer"))
def top_reasons_customer(spark, sf):
    return R.top_reasons(bookings_clean(spark, sf), "reason_for_cancelling_by_customer")


@register("top_reasons_driver", _reasons_sql("driver_cancellation_reason"))
def top_reasons_driver(spark, sf):
    return R.top_reasons(bookings_clean(spark, sf), "driver_cancellation_reason")


# ---------------------------------------------------------------------------
# R4 vehicle type
# ---------------------------------------------------------------------------
_SUCCESS = pr(f"avg({flag("booking_status = 'Completed'")}) * 100.0", 1)
_VEHICLE_G = f"""
g AS (SELECT vehicle_type, count(booking_id) AS total_bookings, {_SUCCESS} AS success_rate,
             avg(ride_distance) AS avg_distance, sum(ride_distance) AS total_distance
      FROM B_clean GROUP BY vehicle_type)
"""

_VEHICLE_SUMMARY_SQL = with_views(
    f"""
SELECT vehicle_type, CAST(total_bookings AS BIGINT) AS total_bookings, success_rate,
       {pr("avg_distance", 2)} AS avg_distance_km, CAST({pr("total_distance", 0)} AS BIGINT) AS total_distance_km
FROM g
""",
    _VEHICLE_G,
)


@register("vehicle_summary", _VEHICLE_SUMMARY_SQL)
def vehicle_summary(spark, sf):
    return R.vehicle_summary(bookings_clean(spark, sf))


_VEHICLE_KPIS_SQL = with_views(
    f"""
SELECT CAST(count(DISTINCT vehicle_type) AS BIGINT) AS n_types,
       {pr("CAST((SELECT sum(total_bookings) FROM t3) AS DOUBLE) * 100.0 / CAST(sum(total_bookings) AS DOUBLE)", 4)} AS top3_pct,
       min(success_rate) AS success_min, max(success_rate) AS success_max,
       {pr("avg(avg_distance)", 4)} AS distance_mean, {pr("min(avg_distance)", 4)} AS distance_min,
       {pr("max(avg_distance)", 4)} AS distance_max,
       (SELECT vehicle_type FROM g ORDER BY total_bookings DESC, vehicle_type ASC LIMIT 1) AS top_type,
       (SELECT CAST(total_bookings AS BIGINT) FROM g ORDER BY total_bookings DESC, vehicle_type ASC LIMIT 1) AS top_bookings,
       (SELECT CAST(round_even(total_bookings * CAST(0.01 AS DOUBLE), 0) AS BIGINT) FROM g
        ORDER BY total_bookings DESC, vehicle_type ASC LIMIT 1) AS top_plus1pp,
       (SELECT vehicle_type FROM g ORDER BY success_rate DESC, vehicle_type ASC LIMIT 1) AS best_success_type,
       max(success_rate) AS best_success_rate,
       {pr("CAST(COALESCE(sum(total_bookings) FILTER (WHERE lower(vehicle_type) LIKE '%xl%'), 0) AS DOUBLE) * 100.0 / CAST(sum(total_bookings) AS DOUBLE)", 4)} AS xl_pct
FROM g
""",
    _VEHICLE_G + ", t3 AS (SELECT total_bookings FROM g ORDER BY total_bookings DESC, vehicle_type ASC LIMIT 3)",
)


@register("vehicle_kpis", _VEHICLE_KPIS_SQL)
def vehicle_kpis(spark, sf):
    return R.vehicle_kpis(bookings_clean(spark, sf))


_SEGMENT_PCT = pr(
    "CAST(count(booking_id) FILTER (WHERE lower(vehicle_type) LIKE '%xl%') AS DOUBLE) * 100.0 "
    "/ CAST(count(booking_id) AS DOUBLE)", 4)
_SEGMENT_SQL = with_views(f"SELECT {_SEGMENT_PCT} AS segment_pct FROM B_clean")


@register("segment_share", _SEGMENT_SQL)
def segment_share(spark, sf):
    return R.segment_share(bookings_clean(spark, sf), "XL")


_VEHICLE_TEXT_SQL = with_views(
    f"""
SELECT vehicle_type, CAST(total_bookings AS BIGINT) AS total_bookings,
       CAST(sr AS VARCHAR) || '%' AS success_rate,
       CAST({pr("a", 2)} AS VARCHAR) || ' km' AS avg_distance,
       CAST(CAST({pr("s / 1000.0", 0)} AS BIGINT) AS VARCHAR) || 'K km' AS total_distance
FROM g
""",
    f"""
g AS (SELECT vehicle_type, count(booking_id) AS total_bookings, {_SUCCESS} AS sr,
             avg(ride_distance) AS a, sum(ride_distance) AS s
      FROM B WHERE vehicle_type IS NOT NULL GROUP BY vehicle_type)
""",
)


@register("vehicle_summary_text", _VEHICLE_TEXT_SQL)
def vehicle_summary_text(spark, sf):
    return R.vehicle_summary_text(bookings(spark, sf))


# ---------------------------------------------------------------------------
# A4 / A9 generic group summary and value stats
# ---------------------------------------------------------------------------
@register("value_stats", with_views(
    f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(booking_value) AS BIGINT) AS n_valid,
               {pr("sum(booking_value)", 4)} AS total, {pr("avg(booking_value)", 4)} AS mean,
               min(booking_value) AS min, max(booking_value) AS max,
               {pr("max(booking_value) - min(booking_value)", 4)} AS span FROM B"""))
def value_stats(spark, sf):
    """Rows, valid values, sum, mean, min, max and span of the raw booking value."""
    from ridelens.operators.common import kpis

    return kpis(bookings(spark, sf), "booking_value")


@register("payment_group_summary", with_views(
    f"""SELECT payment_method, CAST(count(*) AS BIGINT) AS rides, CAST(count(booking_value) AS BIGINT) AS valued,
               {pr("avg(booking_value)", 4)} AS mean_value, {pr("sum(booking_value)", 4)} AS total_value,
               min(ride_distance) AS min_distance, max(ride_distance) AS max_distance,
               CAST(count(DISTINCT vehicle_type) AS BIGINT) AS vehicle_types
        FROM B GROUP BY payment_method"""))
def payment_group_summary(spark, sf):
    """Named aggregates per payment method, NULL method kept as a group (A4)."""
    from ridelens.operators.common import group_summary

    g = group_summary(bookings(spark, sf), "payment_method", {
        "rides": ("booking_id", "size"), "valued": ("booking_value", "count"),
        "mean_value": ("booking_value", "mean"), "total_value": ("booking_value", "sum"),
        "min_distance": ("ride_distance", "min"), "max_distance": ("ride_distance", "max"),
        "vehicle_types": ("vehicle_type", "nunique")})
    return g.withColumns({"mean_value": pround("mean_value", 4), "total_value": pround("total_value", 4)})


_STATUS_TOTAL_B_SQL = with_views(
    """
SELECT booking_status, CAST(n AS BIGINT) AS n, pct, is_total FROM s
UNION ALL
SELECT 'Total', CAST(sum(n) AS BIGINT), """ + pr("sum(pct)", 1) + """, true FROM s
""",
    f"""
c AS (SELECT booking_status, count(*) AS n FROM B WHERE booking_status IS NOT NULL GROUP BY 1),
s AS (SELECT booking_status, n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct, false AS is_total FROM c)
""",
)


@register("status_mix_total_bookings", _STATUS_TOTAL_B_SQL)
def status_mix_total_bookings(spark, sf):
    """Booking-status counts and shares with the printed total row (A47) on the bookings."""
    return R.counts_with_total(bookings(spark, sf), "booking_status")
