"""Trip, demand, payment, ratings and uplift reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.functions import MONTH_NAMES, NIGHT_HOURS, PEAK_HOURS, WEEKDAY_NAMES
from ridelens.operators import bins as BN
from ridelens.operators import time as TM
from ridelens.plans import reports as R
from ridelens.plans.oracle_views import with_views
from ridelens.plans.registry import register
from ridelens.plans.sqltext import case_bins, flag, label_table, pr, share, values_table
from ridelens.sources.driver_views import bookings_clean, table

# ---------------------------------------------------------------------------
# R5 trip characteristics
# ---------------------------------------------------------------------------
_T = "t AS (SELECT ride_distance, avg_vtat FROM B_clean WHERE ride_distance IS NOT NULL AND avg_vtat IS NOT NULL)"


def _binned_summary_sql(col: str, edges, labels) -> str:
    return with_views(
        f"""
SELECT g.bin_idx, s.label, CAST(g.n AS BIGINT) AS n, g.avg_vtat_min, g.avg_distance_km,
       {share("g.n", "(SELECT sum(n) FROM g)", 1)} AS pct
FROM g JOIN s ON g.bin_idx = s.bin_idx
""",
        f"""
{_T},
bn AS (SELECT {case_bins(col, edges)} AS bin_idx, avg_vtat, ride_distance FROM t),
g AS (SELECT bin_idx, count(*) AS n, {pr("avg(avg_vtat)", 1)} AS avg_vtat_min,
             {pr("avg(ride_distance)", 2)} AS avg_distance_km
      FROM bn WHERE bin_idx IS NOT NULL GROUP BY bin_idx),
{label_table("s", labels)}
""",
    )


@register("distance_bins", _binned_summary_sql("ride_distance", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS))
def distance_bins(spark, sf):
    return R.distance_bins(bookings_clean(spark, sf))


@register("wait_bins", _binned_summary_sql("avg_vtat", BN.VTAT_EDGES, BN.VTAT_LABELS))
def wait_bins(spark, sf):
    return R.wait_bins(bookings_clean(spark, sf))


_JOINT_SQL = with_views(
    """
SELECT ux.x_idx, sx.x_label, uy.y_idx, sy.y_label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM ux CROSS JOIN uy
LEFT JOIN c ON c.x_idx = ux.x_idx AND c.y_idx = uy.y_idx
JOIN sx ON sx.x_idx = ux.x_idx JOIN sy ON sy.y_idx = uy.y_idx
""",
    f"""
{_T},
bn AS (SELECT {case_bins("ride_distance", BN.DISTANCE_EDGES)} AS x_idx,
             {case_bins("avg_vtat", BN.VTAT_EDGES)} AS y_idx FROM t),
ux AS (SELECT DISTINCT x_idx FROM bn WHERE x_idx IS NOT NULL),
uy AS (SELECT DISTINCT y_idx FROM bn WHERE y_idx IS NOT NULL),
c AS (SELECT x_idx, y_idx, count(*) AS n FROM bn WHERE x_idx IS NOT NULL AND y_idx IS NOT NULL GROUP BY 1, 2),
{label_table("sx", BN.DISTANCE_LABELS, "x_idx", "x_label")},
{label_table("sy", BN.VTAT_LABELS, "y_idx", "y_label")}
""",
)


@register("distance_wait_joint", _JOINT_SQL)
def distance_wait_joint(spark, sf):
    return R.distance_wait_joint(bookings_clean(spark, sf))


_TRIP_KPIS_SQL = with_views(
    f"""
SELECT {pr(f"avg({flag(case_bins('ride_distance', BN.DISTANCE_EDGES) + ' = 0')}) * 100.0", 4)} AS pct_le_5km,
       {pr(f"avg({flag(case_bins('avg_vtat', BN.VTAT_EDGES) + ' IN (0, 1)')}) * 100.0", 4)} AS pct_vtat_le_10,
       {pr("quantile_cont(avg_vtat, 0.95)", 4)} AS vtat_p95
FROM t
""",
    _T,
)


@register("trip_kpis", _TRIP_KPIS_SQL)
def trip_kpis(spark, sf):
    return R.trip_kpis(bookings_clean(spark, sf))


_SLOWEST_SQL = with_views(
    f"""
SELECT g.bin_idx, s.label, {pr("g.av", 4)} AS avg_vtat, CAST(g.n AS BIGINT) AS n
FROM g JOIN s ON g.bin_idx = s.bin_idx
ORDER BY g.av DESC, g.n DESC, g.bin_idx ASC LIMIT 1
""",
    f"""
{_T},
g AS (SELECT {case_bins("ride_distance", BN.DISTANCE_EDGES)} AS bin_idx, count(*) AS n, avg(avg_vtat) AS av
      FROM t GROUP BY 1 HAVING bin_idx IS NOT NULL),
{label_table("s", BN.DISTANCE_LABELS)}
""",
)


@register("slowest_bin", _SLOWEST_SQL)
def slowest_bin(spark, sf):
    return R.slowest_bin(bookings_clean(spark, sf))


# ---------------------------------------------------------------------------
# R6 demand patterns
# ---------------------------------------------------------------------------
def _time_sql(src: str) -> str:
    return f"""
t0 AS (SELECT CAST(hour AS INTEGER) AS h, CAST(weekday AS INTEGER) AS w, CAST(month AS INTEGER) AS m
       FROM {src} WHERE hour IS NOT NULL AND weekday IS NOT NULL AND month IS NOT NULL),
t AS (SELECT least(greatest(h, 0), 23) AS hour,
             CASE WHEN (SELECT min(w) FROM t0) >= 1 AND (SELECT max(w) FROM t0) <= 7 THEN w - 1
                  ELSE least(greatest(w, 0), 6) END AS weekday,
             least(greatest(m, 1), 12) AS month
      FROM t0)
"""


_ORDERS_TIME = """
o AS (SELECT CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
             CAST(month(o_orderdate) AS INTEGER) AS month FROM orders),
"""


def orders_time(spark, sf):
    """Order dates as (hour, weekday, month) – 12 months of demand."""
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        F.hour(d).alias("hour"), F.weekday(d).alias("weekday"), F.month(d).alias("month"))


def _names(name: str, col: str, names) -> str:
    return values_table(name, [col, f"{col}_name"], [(i + (1 if col == "month" else 0), s) for i, s in enumerate(names)])


@register("demand_hour", with_views(
    f"SELECT hour, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct FROM c",
    _time_sql("B_clean") + ", c AS (SELECT hour, count(*) AS n FROM t GROUP BY 1)"))
def demand_hour(spark, sf):
    return TM.demand_by(bookings_clean(spark, sf), "hour")


@register("demand_weekday", with_views(
    f"""SELECT c.weekday, nm.weekday_name, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct
        FROM c LEFT JOIN nm ON c.weekday = nm.weekday""",
    _time_sql("B_clean") + ", c AS (SELECT weekday, count(*) AS n FROM t GROUP BY 1), "
    + _names("nm", "weekday", WEEKDAY_NAMES)))
def demand_weekday(spark, sf):
    return TM.demand_by(bookings_clean(spark, sf), "weekday")


@register("demand_month", with_views(
    f"""SELECT c.month, nm.month_name, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct
        FROM c LEFT JOIN nm ON c.month = nm.month""",
    _ORDERS_TIME + _time_sql("o") + ", c AS (SELECT month, count(*) AS n FROM t GROUP BY 1), "
    + _names("nm", "month", MONTH_NAMES)))
def demand_month(spark, sf):
    return TM.demand_by(orders_time(spark, sf), "month")


@register("demand_kpis", with_views(
    """SELECT round_even(avg(n), 0) AS avg_rides_per_hour,
              (SELECT hour FROM g ORDER BY n DESC, hour ASC LIMIT 1) AS busiest_hour,
              CAST(max(n) AS BIGINT) AS busiest_n FROM g""",
    _time_sql("B_clean") + ", g AS (SELECT hour, count(*) AS n FROM t GROUP BY 1)"))
def demand_kpis(spark, sf):
    return TM.demand_kpis(bookings_clean(spark, sf))


def _in(values) -> str:
    return ", ".join(str(v) for v in values)


@register("peak_shares", with_views(
    f"""SELECT {pr(f"avg({flag(f'hour IN ({_in(PEAK_HOURS)})')}) * 100.0", 4)} AS peak_pct,
               {pr(f"avg({flag(f'hour IN ({_in(NIGHT_HOURS)})')}) * 100.0", 4)} AS night_pct
        FROM B_clean"""))
def peak_shares(spark, sf):
    return TM.rate_of(bookings_clean(spark, sf), {
        "peak_pct": F.col("hour").isin(*PEAK_HOURS), "night_pct": F.col("hour").isin(*NIGHT_HOURS)}, digits=4)


# ---------------------------------------------------------------------------
# R7 payment methods
# ---------------------------------------------------------------------------
@register("payment_mix", with_views(
    f"SELECT payment_method, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct FROM c",
    "c AS (SELECT COALESCE(payment_method, 'Unknown') AS payment_method, count(*) AS n FROM B_clean GROUP BY 1)"))
def payment_mix(spark, sf):
    return R.payment_mix(bookings_clean(spark, sf))


@register("payment_mix_raw", with_views(
    f"SELECT payment_method, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct FROM c",
    "c AS (SELECT COALESCE(payment_method, 'Unknown') AS payment_method, count(*) AS n FROM B GROUP BY 1)"))
def payment_mix_raw(spark, sf):
    """Payment mix before cleaning: missing methods show as ``Unknown``."""
    from ridelens.sources.driver_views import bookings

    return R.payment_mix(bookings(spark, sf))


# ---------------------------------------------------------------------------
# R8 ratings
# ---------------------------------------------------------------------------
_RATING_SPINE = values_table("sp", ["type", "rating"], [(t, r) for t in ("Driver", "Customer") for r in range(1, 6)])


@register("ratings_distribution", with_views(
    f"""SELECT sp.type, CAST(sp.rating AS INTEGER) AS rating, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
               {share('COALESCE(c.n, 0)', '(SELECT count(*) FROM B_clean)', 2)} AS pct
        FROM sp LEFT JOIN c ON sp.type = c.type AND sp.rating = c.rating""",
    f"""
lg AS (SELECT 'Driver' AS type, driver_rating AS r FROM B_clean
       UNION ALL SELECT 'Customer' AS type, customer_rating AS r FROM B_clean),
c AS (SELECT type, CAST(r AS INTEGER) AS rating, count(*) AS n FROM lg WHERE r IN (1, 2, 3, 4, 5) GROUP BY 1, 2),
{_RATING_SPINE}
"""))
def ratings_distribution(spark, sf):
    return R.ratings_distribution(bookings_clean(spark, sf))


def _le3(c: str) -> str:
    return pr(f"CAST(count(*) FILTER (WHERE {c} IN (1, 2, 3)) AS DOUBLE) / "
              f"CAST(greatest(count(*) FILTER (WHERE NOT COALESCE({c} = -1, false)), 1) AS DOUBLE) * 100.0", 4)


@register("low_rating_share", with_views(
    f"SELECT {_le3('driver_rating')} AS driver_le3_pct, {_le3('customer_rating')} AS customer_le3_pct FROM B_clean"))
def low_rating_share(spark, sf):
    return R.low_rating_share(bookings_clean(spark, sf))


def _rk(c: str, side: str) -> str:
    return (f"{pr(f'avg(CASE WHEN NOT COALESCE({c} = -1, false) THEN {c} END)', 2)} AS {side}_avg, "
            f"{pr(f'avg({flag(f'COALESCE({c} = -1, false)')}) * 100.0', 1)} AS {side}_unrated_pct")


@register("ratings_kpis", with_views(
    f"SELECT {_rk('driver_rating', 'driver')}, {_rk('customer_rating', 'customer')} FROM B_clean"))
def ratings_kpis(spark, sf):
    return R.ratings_kpis(bookings_clean(spark, sf))


# ---------------------------------------------------------------------------
# R9 uplift
# ---------------------------------------------------------------------------
_BASE = "(SELECT avg_usd FROM a) * CAST(count(*) AS DOUBLE)"


@register("uplift", with_views(
    f"""SELECT CAST(count(*) AS BIGINT) AS total_rides, {pr("(SELECT avg_usd FROM a)", 4)} AS avg_usd,
               {pr(_BASE, 4)} AS baseline,
               {pr(_BASE + " * CAST(0.08 AS DOUBLE)", 4)} AS uplift_low,
               {pr(_BASE + " * CAST(0.13 AS DOUBLE)", 4)} AS uplift_high,
               {pr(_BASE + " * CAST(0.08 AS DOUBLE) / 12.0", 4)} AS month_low,
               {pr(_BASE + " * CAST(0.13 AS DOUBLE) / 12.0", 4)} AS month_high
        FROM B_clean""",
    "a AS (SELECT avg(booking_value * CAST(0.011 AS DOUBLE)) AS avg_usd FROM B_clean WHERE booking_value >= 0)"))
def uplift(spark, sf):
    return R.uplift(bookings_clean(spark, sf))
