"""Region scope, hot spots, heat-maps, service quality, revenue and vehicle mix."""

from __future__ import annotations

from ridelens.functions import WEEKDAY_ABBR
from ridelens.operators import bins as BN
from ridelens.operators import geo as G
from ridelens.operators import time as TM
from ridelens.plans import reports as R
from ridelens.plans.oracle_views import with_views
from ridelens.plans.registry import register
from ridelens.plans.sqltext import case_bins, flag, label_table, pr, values_table
from ridelens.sources.driver_views import bookings_clean, locations

HOURS = [f"h{h:02d}" for h in range(24)]


def region(spark, sf):
    """``B_region``: cleaned bookings inside the default box, values in USD."""
    return G.region_bookings(bookings_clean(spark, sf), locations(spark, sf))


# ---------------------------------------------------------------------------
# geo joins and region scope
# ---------------------------------------------------------------------------
_GEO_COLS = ("booking_id, pickup_location, drop_location, pickup_latitude, pickup_longitude, "
             "drop_latitude, drop_longitude")


@register("geocoded_bookings", with_views(f"SELECT {_GEO_COLS} FROM B_geo"))
def geocoded_bookings(spark, sf):
    g = G.enrich_pickup_drop(bookings_clean(spark, sf), locations(spark, sf))
    return g.select(*[c.strip() for c in _GEO_COLS.split(",")])


@register("region_bookings", with_views("SELECT * FROM B_region"))
def region_bookings(spark, sf):
    return region(spark, sf)


@register("region_share", with_views(
    f"""SELECT CAST((SELECT count(*) FROM B_clean) AS BIGINT) AS total_all,
               CAST((SELECT count(*) FROM B_region) AS BIGINT) AS total_region,
               {pr("CAST((SELECT count(*) FROM B_region) AS DOUBLE) / greatest(CAST((SELECT count(*) FROM B_clean) AS DOUBLE), 1.0) * 100.0", 4)} AS region_pct"""))
def region_share(spark, sf):
    return G.region_share_one_pass(bookings_clean(spark, sf), locations(spark, sf))


# ---------------------------------------------------------------------------
# hot spots and heat-maps
# ---------------------------------------------------------------------------
def _top_loc_sql(col: str) -> str:
    return with_views(f"""
SELECT CAST({col} AS VARCHAR) AS location, CAST(count(*) AS BIGINT) AS n FROM B_region WHERE {col} IS NOT NULL
GROUP BY 1 ORDER BY n DESC, location ASC LIMIT 10""")


@register("top_pickups", _top_loc_sql("pickup_location"))
def top_pickups(spark, sf):
    return R.top_locations(region(spark, sf), "pickup_location", 10)


@register("top_drops", _top_loc_sql("drop_location"))
def top_drops(spark, sf):
    return R.top_locations(region(spark, sf), "drop_location", 10)


def _hour_cols(src: str = "c", fill: str = "0", agg: str = "sum(n)") -> str:
    return ", ".join(
        f"CAST(COALESCE({agg} FILTER (WHERE {src}.hour = {h}), {fill}) AS BIGINT) AS h{h:02d}" for h in range(24))


_HEAT_SQL = with_views(
    f"""
SELECT wd.weekday, wd.weekday_name, {_hour_cols()}
FROM wd LEFT JOIN c ON wd.weekday = c.weekday GROUP BY wd.weekday, wd.weekday_name
""",
    f"""
t0 AS (SELECT weekday AS w, hour AS h FROM B_region),
fl AS (SELECT max(CASE WHEN w BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS any17,
              max(CASE WHEN w BETWEEN 0 AND 6 THEN 1 ELSE 0 END) AS any06,
              max(CASE WHEN h BETWEEN 1 AND 24 THEN 1 ELSE 0 END) AS any124,
              max(CASE WHEN h BETWEEN 0 AND 23 THEN 1 ELSE 0 END) AS any023 FROM t0),
t1 AS (SELECT CASE WHEN fl.any17 = 1 AND fl.any06 = 0 AND w BETWEEN 1 AND 7 THEN w - 1 ELSE w END AS weekday,
              CASE WHEN fl.any124 = 1 AND fl.any023 = 0 AND h BETWEEN 1 AND 24 THEN h % 24 ELSE h END AS hour
       FROM t0, fl),
c AS (SELECT weekday, hour, count(*) AS n FROM t1
      WHERE weekday BETWEEN 0 AND 6 AND hour BETWEEN 0 AND 23 GROUP BY 1, 2),
{values_table("wd", ["weekday", "weekday_name"], list(enumerate(WEEKDAY_ABBR)))}
""",
)


@register("heatmap_weekday_hour", _HEAT_SQL)
def heatmap_weekday_hour(spark, sf):
    return TM.heatmap_weekday_hour(region(spark, sf))


_ZONE_HEAT_SQL = with_views(
    f"""
SELECT CAST(tz.zone_rank AS INTEGER) AS zone_rank, tz.location, {_hour_cols()}
FROM tz LEFT JOIN c ON tz.location = c.location GROUP BY tz.zone_rank, tz.location
""",
    """
z AS (SELECT CAST(pickup_location AS VARCHAR) AS location, count(*) AS n FROM B_region
      WHERE pickup_location IS NOT NULL GROUP BY 1),
tz AS (SELECT location, row_number() OVER (ORDER BY n DESC, location ASC) AS zone_rank FROM z
       ORDER BY n DESC, location ASC LIMIT 10),
c AS (SELECT CAST(pickup_location AS VARCHAR) AS location, CAST(hour AS INTEGER) AS hour, count(*) AS n
      FROM B_region WHERE hour BETWEEN 0 AND 23 AND pickup_location IN (SELECT location FROM tz) GROUP BY 1, 2)
""",
)


@register("heatmap_topzone_hour", _ZONE_HEAT_SQL)
def heatmap_topzone_hour(spark, sf):
    return R.heatmap_topzone_hour(region(spark, sf), 10)


# ---------------------------------------------------------------------------
# R11 service quality
# ---------------------------------------------------------------------------
_SVC = "d AS (SELECT * FROM B_region WHERE avg_vtat IS NOT NULL AND hour BETWEEN 0 AND 23)"


@register("service_quality", with_views(
    f"""SELECT CAST(count(*) AS BIGINT) AS n, {pr("median(avg_vtat)", 4)} AS median_vtat,
               {pr(f"avg({flag('avg_vtat <= 10')}) * 100.0", 4)} AS pct_le_10 FROM d""", _SVC))
def service_quality(spark, sf):
    return R.service_quality(region(spark, sf))


@register("service_quality_peak", with_views(
    f"""SELECT CAST(count(*) AS BIGINT) AS n, {pr("median(avg_vtat)", 4)} AS median_vtat,
               {pr(f"avg({flag('avg_vtat <= 10')}) * 100.0", 4)} AS pct_le_10 FROM d
        WHERE hour BETWEEN 7 AND 11""", _SVC))
def service_quality_peak(spark, sf):
    """Same KPIs for a user hour range (7–11)."""
    return R.service_quality(region(spark, sf), 7, 11)


@register("service_bins_trimmed", with_views(
    """SELECT bin_idx, label, CAST(rides AS BIGINT) AS rides FROM f
       WHERE bin_idx <= COALESCE((SELECT max(bin_idx) FROM f WHERE rides > 0), -1)""",
    f"""{_SVC},
c AS (SELECT {case_bins("avg_vtat", BN.WAIT_EDGES)} AS bin_idx, count(*) AS rides FROM d GROUP BY 1),
{label_table("s", BN.WAIT_LABELS)},
f AS (SELECT s.bin_idx, s.label, COALESCE(c.rides, 0) AS rides FROM s LEFT JOIN c ON s.bin_idx = c.bin_idx)"""))
def service_bins_trimmed(spark, sf):
    return R.service_bins(region(spark, sf))


@register("zone_service", with_views(
    f"""SELECT pickup_location, {pr("avg(avg_vtat)", 4)} AS avg_vtat, CAST(count(pickup_location) AS BIGINT) AS rides,
               {pr("avg(pickup_latitude)", 4)} AS lat, {pr("avg(pickup_longitude)", 4)} AS lon
        FROM d WHERE pickup_location IS NOT NULL AND pickup_latitude IS NOT NULL AND pickup_longitude IS NOT NULL
        GROUP BY pickup_location""", _SVC))
def zone_service(spark, sf):
    return R.zone_service(region(spark, sf))


# ---------------------------------------------------------------------------
# R12 revenue structure
# ---------------------------------------------------------------------------
_REV = """d0 AS (SELECT booking_value, pickup_location, CAST(hour AS INTEGER) AS hour FROM B_region
       WHERE booking_value IS NOT NULL AND pickup_location IS NOT NULL AND hour IS NOT NULL
         AND hour BETWEEN 0 AND 23 AND booking_value > 0)"""
_PCT_0_5 = pr(f"avg({flag('booking_value BETWEEN 0 AND 5')}) * 100.0", 4)
_ZK = (f"CAST(count(*) AS BIGINT) AS rides, {pr('avg(booking_value)', 4)} AS avg_usd, "
       f"{_PCT_0_5} AS pct_0_5, {pr('median(booking_value)', 4)} AS median_usd")


@register("revenue_kpis", with_views(f"SELECT {_ZK} FROM d0", _REV))
def revenue_kpis(spark, sf):
    return R.zone_kpis(region(spark, sf), by_zone=False)


@register("zone_kpis", with_views(f"SELECT pickup_location, {_ZK} FROM d0 GROUP BY pickup_location", _REV))
def zone_kpis(spark, sf):
    few = locations(spark, sf).count() <= 100_000
    return R.zone_kpis(region(spark, sf), few_zones=few)


@register("zone_kpis_one", with_views(f"SELECT {_ZK} FROM d0 WHERE pickup_location = 'NATION_5'", _REV))
def zone_kpis_one(spark, sf):
    """Revenue KPIs of one zone."""
    return R.zone_kpis(region(spark, sf), zone="NATION_5", by_zone=False)


@register("revenue_by_zone", with_views(
    f"""SELECT CAST(row_number() OVER (ORDER BY revenue DESC, pickup_location ASC) AS INTEGER) AS rank,
               pickup_location, {pr("revenue", 4)} AS revenue
        FROM g ORDER BY revenue DESC, pickup_location ASC LIMIT 10""",
    _REV + ", g AS (SELECT pickup_location, sum(booking_value) AS revenue FROM d0 GROUP BY 1)"))
def revenue_by_zone(spark, sf):
    return R.revenue_by_zone(region(spark, sf), 10)


@register("top5_zone_share", with_views(
    f"""SELECT {pr("COALESCE((SELECT sum(revenue) FROM t5) * 100.0 / (SELECT sum(revenue) FROM g), 0.0)", 4)}
               AS top_share_pct""",
    _REV + """, g AS (SELECT pickup_location, sum(booking_value) AS revenue FROM d0 GROUP BY 1),
    t5 AS (SELECT revenue FROM g ORDER BY revenue DESC, pickup_location ASC LIMIT 5)"""))
def top5_zone_share(spark, sf):
    return R.top_zone_share(region(spark, sf), 5)


@register("revenue_value_bins", with_views(
    """SELECT s.bin_idx, s.label, CAST(COALESCE(c.rides, 0) AS BIGINT) AS rides
       FROM s LEFT JOIN c ON s.bin_idx = c.bin_idx""",
    f"""{_REV},
c AS (SELECT {case_bins("booking_value", BN.VALUE_USD_EDGES)} AS bin_idx, count(*) AS rides FROM d0 GROUP BY 1),
{label_table("s", BN.VALUE_USD_LABELS)}"""))
def revenue_value_bins(spark, sf):
    return R.revenue_value_bins(region(spark, sf))


@register("arpu_by_hour", with_views(
    f"""SELECT hh.hour, {pr("a.arpu", 4)} AS arpu FROM hh LEFT JOIN a ON hh.hour = a.hour""",
    _REV + """, a AS (SELECT hour, avg(booking_value) AS arpu FROM d0 GROUP BY 1),
    hh AS (SELECT CAST(range AS INTEGER) AS hour FROM range(24))"""))
def arpu_by_hour(spark, sf):
    return R.arpu_by_hour(region(spark, sf))


_ZONE_ARPU_COLS = ", ".join(
    f"{pr(f'avg(booking_value) FILTER (WHERE hour = {h})', 4)} AS h{h:02d}" for h in range(24))


@register("arpu_by_zone_hour", with_views(
    f"SELECT pickup_location, {_ZONE_ARPU_COLS} FROM d0 GROUP BY pickup_location", _REV))
def arpu_by_zone_hour(spark, sf):
    return R.arpu_by_zone_hour(region(spark, sf))


@register("zone_options", with_views("SELECT DISTINCT pickup_location FROM d0 ORDER BY 1", _REV))
def zone_options(spark, sf):
    return R.zone_options(region(spark, sf))


# ---------------------------------------------------------------------------
# R13 vehicle mix & trip length
# ---------------------------------------------------------------------------
@register("vehicle_mix", with_views(
    f"""SELECT vehicle_type, CAST(count(vehicle_type) AS BIGINT) AS rides, {pr("avg(booking_value)", 4)} AS avg_fare,
               {pr("sum(booking_value)", 4)} AS revenue, {pr("sum(booking_value) / 1000.0", 4)} AS revenue_k
        FROM B_region WHERE vehicle_type IS NOT NULL GROUP BY vehicle_type"""))
def vehicle_mix(spark, sf):
    return R.vehicle_mix(region(spark, sf))


@register("mix_kpis", with_views(
    f"""SELECT {pr("COALESCE(CAST((SELECT sum(n) FROM t3) AS DOUBLE) * 100.0 / CAST((SELECT sum(n) FROM vc) AS DOUBLE), 0.0)", 4)} AS top3_pct,
               {pr(f"avg({flag('ride_distance < 5')}) * 100.0", 4)} AS pct_lt_5km
        FROM B_region""",
    """vc AS (SELECT vehicle_type, count(*) AS n FROM B_region WHERE vehicle_type IS NOT NULL GROUP BY 1),
    t3 AS (SELECT n FROM vc ORDER BY n DESC, vehicle_type ASC LIMIT 3)"""))
def mix_kpis(spark, sf):
    return R.mix_kpis(region(spark, sf))


@register("distance_vs_wait_median", with_views(
    f"""SELECT s.bin_idx, s.label, {pr("m.med", 4)} AS median_vtat FROM s LEFT JOIN m ON s.bin_idx = m.bin_idx""",
    f"""t AS (SELECT ride_distance, avg_vtat FROM B_region WHERE ride_distance IS NOT NULL AND avg_vtat IS NOT NULL),
m AS (SELECT {case_bins("ride_distance", BN.TRIP_LENGTH_EDGES)} AS bin_idx, median(avg_vtat) AS med FROM t
      GROUP BY 1 HAVING bin_idx IS NOT NULL),
{label_table("s", BN.TRIP_LENGTH_LABELS)}"""))
def distance_vs_wait_median(spark, sf):
    return R.distance_vs_wait_median(region(spark, sf))



# ---------------------------------------------------------------------------
# J8 route points, A34 history modes (scorer defaults)
# ---------------------------------------------------------------------------
@register("route_points", with_views(
    """SELECT booking_id, COALESCE(pickup_latitude, 0.0) AS pickup_latitude,
              COALESCE(pickup_longitude, 0.0) AS pickup_longitude,
              COALESCE(drop_latitude, 0.0) AS drop_latitude, COALESCE(drop_longitude, 0.0) AS drop_longitude
       FROM B_geo
       WHERE COALESCE(pickup_latitude, 0.0) <> 0 AND COALESCE(pickup_longitude, 0.0) <> 0
         AND COALESCE(drop_latitude, 0.0) <> 0 AND COALESCE(drop_longitude, 0.0) <> 0"""))
def route_points(spark, sf):
    """Pickup → drop point pairs of every booking whose four coordinates are known
    (geocoded with the scorer's 0.0 default, then zero points dropped)."""
    g = G.enrich_pickup_drop(bookings_clean(spark, sf), locations(spark, sf), default=0.0)
    return G.route_points(g).select("booking_id", "pickup_latitude", "pickup_longitude", "drop_latitude",
                                    "drop_longitude")


def _mode_sql(col: str, default: str) -> str:
    return (f"COALESCE((SELECT CAST({col} AS VARCHAR) FROM B_region WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} ASC LIMIT 1), '{default}')")


@register("history_modes", with_views(
    f"""SELECT {_mode_sql('month', 'January')} AS month, {_mode_sql('day', '1')} AS day,
               {_mode_sql('booking_status', 'Completed')} AS booking_status,
               {_mode_sql('payment_method', 'UPI')} AS payment_method"""))
def history_modes(spark, sf):
    """Most frequent month, day, status and payment of the region history, with the
    scorer's defaults when a column has no value (A34, M29)."""
    from ridelens.ml.score import MODE_DEFAULTS
    from ridelens.operators.common import modes

    return modes(region(spark, sf), MODE_DEFAULTS)
