"""Dashboard panels as lazy DataFrame reports.

Each function takes the bookings table(s) and returns a DataFrame; nothing here
triggers a job. The callers (catalogue, bench, users) choose ``write`` or
``collect``. Float outputs are rounded half-even so results are stable across
engines and partitionings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import (
    as_flag,
    between,
    bin_index,
    contains_ci,
    numeric,
    pround,
    to_long,
    with_unit,
)
from ridelens.operators import bins as BN
from ridelens.operators.clean import INR_TO_USD, to_usd, valid_amount
from ridelens.operators.common import (
    arg_max,
    axis_counts,
    axis_frame,
    densify,
    exact_percentiles,
    n_rows,
    order_by_count,
    scalars,
    top_k,
    top_n_share,
    total_of,
    value_counts,
    weight_of,
    with_share,
)
from ridelens.operators.geo import semi_top_k
from ridelens.operators.time import hour_columns, pivot_hours

P = 4  # digits kept for float KPIs


# ---------------------------------------------------------------------------
# R2 booking value
# ---------------------------------------------------------------------------
def usd_values(df: DataFrame, col: str = "booking_value", rate: float = INR_TO_USD,
               min_value: float = 0.0) -> DataFrame:
    """Valid (numeric, ≥ ``min_value``) values converted to USD as ``usd``."""
    v = valid_amount(df.select(col), col, min_value)
    return to_usd(v, col, rate, out="usd").select("usd")


def value_distribution(df: DataFrame, col: str = "booking_value", rate: float = INR_TO_USD) -> DataFrame:
    """USD histogram on the five value bins, share of valid rows (2 dp)."""
    return BN.binned_counts(usd_values(df, col, rate), "usd", BN.VALUE_USD_EDGES, BN.VALUE_USD_LABELS, digits=2)


def value_kpis(df: DataFrame, col: str = "booking_value", rate: float = INR_TO_USD) -> DataFrame:
    """Rows, mean, median (USD) and % in $0–5 (2 dp, as the histogram) – one pass
    for the aggregates and the median's sketch."""
    u = usd_values(df, col, rate)
    k = exact_percentiles(u, "usd", {"m": 0.5}, extra={
        "n": F.count, "avg": F.avg, "c5": lambda v: F.count(F.when(v <= 5, F.lit(1)))})
    return k.select(
        "n", pround("avg", P).alias("avg_usd"), pround("m", P).alias("median_usd"),
        pround(F.col("c5") / F.greatest(F.col("n"), F.lit(1)) * 100.0, 2).alias("pct_0_5"))


def value_tail(df: DataFrame, col: str = "booking_value") -> DataFrame:
    """Share (sum of the rounded bin shares) and count of rides ≥ $11."""
    t = BN.tail_share(value_distribution(df, col), from_idx=2)
    return t.select(pround("tail_pct", 2).alias("tail_pct"), F.col("tail_n").cast("long").alias("tail_n"))


# ---------------------------------------------------------------------------
# R3 status
# ---------------------------------------------------------------------------
def status_mix(df: DataFrame, col: str = "booking_status") -> DataFrame:
    """Status counts (NULL kept) and share, 1 dp (A2, A3)."""
    return order_by_count(with_share(value_counts(df, col), "n", 1), "n", col)


def counts_with_total(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """Value counts + share + a final ``Total`` row flagged by ``is_total``.

    The total row's share is the sum of the rounded shares, as printed by the
    reference; it is computed from the aggregated rows only.
    """
    g = with_share(value_counts(df, col, dropna=True), "n", digits)
    g = g.withColumn("is_total", F.lit(False))
    tot = g.agg(
        F.lit("Total").alias(col),
        F.sum("n").alias("n"),
        pround(F.sum("pct"), digits).alias("pct"),
        F.lit(True).alias("is_total"),
    )
    return g.unionByName(tot)


def _pct_expr(name: str, col: str) -> F.Column:
    # pct of the highest-count row whose lower-cased status equals ``name``
    return F.coalesce(
        F.expr(f"max_by(pct, n) FILTER (WHERE lower({col}) = '{name.lower()}')"), F.lit(0.0)
    )


def friction_report(df: DataFrame, col: str = "booking_status") -> DataFrame:
    """Completion, cancellation kinds, total friction and the worst friction.

    Two cancellation figures are reported (D7): ``total_friction_pct`` (customer +
    driver + no driver) and ``cancel_pct`` (every status containing "cancel").
    """
    s = with_share(value_counts(df, col), "n", 1)
    k = s.agg(
        F.sum("n").alias("total_rides"),
        _pct_expr("Completed", col).alias("completion_pct"),
        _pct_expr("Cancelled by Customer", col).alias("cancel_customer_pct"),
        _pct_expr("Cancelled by Driver", col).alias("cancel_driver_pct"),
        _pct_expr("No Driver Found", col).alias("no_driver_pct"),
        _pct_expr("Incomplete", col).alias("incomplete_pct"),
        F.coalesce(F.sum(F.when(contains_ci(col, "cancel"), F.col("pct"))), F.lit(0.0)).alias("cancel_raw"),
    )
    cust, drv, nod = F.col("cancel_customer_pct"), F.col("cancel_driver_pct"), F.col("no_driver_pct")
    top_label = (
        F.when((cust >= drv) & (cust >= nod), F.lit("Customer cancellations"))
        .when(drv >= nod, F.lit("Driver cancellations"))
        .otherwise(F.lit("No driver found"))
    )
    return k.select(
        "total_rides", "completion_pct", "cancel_customer_pct", "cancel_driver_pct", "no_driver_pct",
        "incomplete_pct",
        pround(cust + drv + nod, 1).alias("total_friction_pct"),
        pround("cancel_raw", 1).alias("cancel_pct"),
        to_long(F.col("total_rides") * F.lit(0.01)).alias("plus1pp_rides"),
        top_label.alias("top_friction"),
        F.greatest(cust, drv, nod).alias("top_friction_pct"),
    )


def top_reasons(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Top-k non-null reasons (A37); ties → reason ascending."""
    vc = value_counts(df, col, dropna=True)
    return top_k(vc, "n", k, col).select(F.col(col).alias("reason"), "n")


# ---------------------------------------------------------------------------
# R4 vehicle type
# ---------------------------------------------------------------------------
def _success(status: str = "booking_status") -> F.Column:
    return pround(F.avg(as_flag(F.col(status) == "Completed")) * F.lit(100.0), 1)


def vehicle_groups(df: DataFrame) -> DataFrame:
    """Per vehicle type (NULL kept): bookings, success rate, unrounded distance stats."""
    return df.groupBy("vehicle_type").agg(
        F.count("booking_id").alias("total_bookings"),
        _success().alias("success_rate"),
        F.avg("ride_distance").alias("avg_distance"),
        F.sum("ride_distance").alias("total_distance"),
    )


def vehicle_summary(df: DataFrame) -> DataFrame:
    """Vehicle mix table (A4, A5): rounded distance, whole total distance."""
    g = vehicle_groups(df)
    return g.select(
        "vehicle_type", "total_bookings", "success_rate",
        pround("avg_distance", 2).alias("avg_distance_km"),
        to_long("total_distance").alias("total_distance_km"),
    )


def vehicle_kpis(df: DataFrame) -> DataFrame:
    """Vehicle KPIs (A16, A17, A49): types, top-3 share, success range, distance range,
    top product and its +1 pp lever, best success rate, XL share."""
    g = vehicle_groups(df)
    # one row per vehicle type: the largest three are taken from the gathered counts
    sizes = F.slice(F.reverse(F.array_sort(F.collect_list("total_bookings"))), 1, 3)
    best = F.min_by("vehicle_type", F.struct((-F.col("success_rate")).alias("a"), F.col("vehicle_type").alias("b")))
    top = F.min_by(F.struct("vehicle_type", "total_bookings"),
                   F.struct((-F.col("total_bookings")).alias("a"), F.col("vehicle_type").alias("b")))
    k = g.agg(
        F.count_distinct("vehicle_type").alias("n_types"),
        F.sum("total_bookings").alias("total"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("_top3"),
        F.min("success_rate").alias("success_min"),
        F.max("success_rate").alias("success_max"),
        pround(F.avg("avg_distance"), P).alias("distance_mean"),
        pround(F.min("avg_distance"), P).alias("distance_min"),
        pround(F.max("avg_distance"), P).alias("distance_max"),
        best.alias("best_success_type"),
        F.max("success_rate").alias("best_success_rate"),
        top.alias("_top"),
        F.sum(F.when(contains_ci("vehicle_type", "xl"), F.col("total_bookings")).otherwise(0)).alias("_xl"),
    )
    return k.select(
        "n_types",
        pround(F.try_divide(F.col("_top3").cast("double") * F.lit(100.0), F.col("total").cast("double")), P).alias("top3_pct"),
        "success_min", "success_max", "distance_mean", "distance_min", "distance_max",
        F.col("_top.vehicle_type").alias("top_type"),
        F.col("_top.total_bookings").alias("top_bookings"),
        to_long(F.col("_top.total_bookings") * F.lit(0.01)).alias("top_plus1pp"),
        "best_success_type", "best_success_rate",
        pround(F.try_divide(F.col("_xl").cast("double") * F.lit(100.0), F.col("total").cast("double")), P)
        .alias("xl_pct"),
    )


def segment_share(df: DataFrame, text: str = "XL", col: str = "vehicle_type") -> DataFrame:
    """Share of bookings whose ``col`` contains ``text`` (case-insensitive)."""
    return df.agg(
        pround(F.try_divide(F.count(F.when(contains_ci(col, text), F.col("booking_id"))).cast("double")
                            * F.lit(100.0), F.count("booking_id").cast("double")), P).alias("segment_pct")
    )


def vehicle_summary_text(df: DataFrame) -> DataFrame:
    """Printed vehicle table: ``"61.9%"``, ``"12.35 km"``, ``"45K km"``."""
    g = df.where(F.col("vehicle_type").isNotNull()).groupBy("vehicle_type").agg(
        F.count("booking_id").alias("total_bookings"),
        _success().alias("_sr"),
        F.avg("ride_distance").alias("_avg"),
        F.sum("ride_distance").alias("_sum"),
    )
    return g.select(
        "vehicle_type", "total_bookings",
        F.concat(F.col("_sr").cast("string"), F.lit("%")).alias("success_rate"),
        with_unit("_avg", 2, " km").alias("avg_distance"),
        F.concat(to_long(F.col("_sum") / F.lit(1000.0)).cast("string"), F.lit("K km")).alias("total_distance"),
    )


# ---------------------------------------------------------------------------
# R5 trip characteristics
# ---------------------------------------------------------------------------
def trip_frame(df: DataFrame, dist: str = "ride_distance", vtat: str = "avg_vtat") -> DataFrame:
    return df.select(numeric(df, dist).cast("double").alias("ride_distance"),
                     numeric(df, vtat).cast("double").alias("avg_vtat")).dropna()


_TRIP_MEANS = {"avg_vtat_min": ("avg_vtat", 1), "avg_distance_km": ("ride_distance", 2)}


def distance_bins(df: DataFrame) -> DataFrame:
    return BN.binned_summary(trip_frame(df), "ride_distance", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS, _TRIP_MEANS)


def wait_bins(df: DataFrame) -> DataFrame:
    return BN.binned_summary(trip_frame(df), "avg_vtat", BN.VTAT_EDGES, BN.VTAT_LABELS, _TRIP_MEANS)


def distance_wait_joint(df: DataFrame) -> DataFrame:
    return BN.joint_histogram(trip_frame(df), "ride_distance", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS,
                              "avg_vtat", BN.VTAT_EDGES, BN.VTAT_LABELS)


def trip_kpis(df: DataFrame, approx: bool = False) -> DataFrame:
    """% rides in the 0–5 km bin, % VTAT ≤ 10 min (first two VTAT bins), VTAT p95 –
    the two shares ride along in the p95 sketch's pass (one scan)."""
    t = trip_frame(df)
    d_idx = bin_index("ride_distance", BN.DISTANCE_EDGES)
    k = exact_percentiles(t, "avg_vtat", {"p": 0.95}, approx=approx, carry=["ride_distance"], extra={
        "le5": lambda v: F.avg(as_flag(d_idx == 0)) * F.lit(100.0),
        "le10": lambda v: F.avg(as_flag(bin_index(v, BN.VTAT_EDGES).isin(0, 1))) * F.lit(100.0)})
    return k.select(pround("le5", P).alias("pct_le_5km"), pround("le10", P).alias("pct_vtat_le_10"),
                    pround("p", P).alias("vtat_p95"))


def slowest_bin(df: DataFrame, min_count: int = 0) -> DataFrame:
    """Distance bin with the highest mean VTAT (ties → more rides, lower bin).

    The per-bin count and mean come from one global aggregate (≤ 8 bins); the
    arg-max then runs over those few rows."""
    t = trip_frame(df)
    s = BN.binned_summary(t, "ride_distance", BN.DISTANCE_EDGES, BN.DISTANCE_LABELS,
                          {"avg_vtat": ("avg_vtat", None)}, digits=None)
    s = s.where(F.col("n") >= F.lit(min_count))
    best = arg_max(s, ["avg_vtat", "n"], "bin_idx")
    return best.select("bin_idx", "label", pround("avg_vtat", P).alias("avg_vtat"), "n")


# ---------------------------------------------------------------------------
# R7 payment, R8 ratings, R9 uplift
# ---------------------------------------------------------------------------
def payment_mix(df: DataFrame, col: str = "payment_method") -> DataFrame:
    """Payment counts with NULL → "Unknown" and share 1 dp."""
    filled = df.select(F.coalesce(F.col(col), F.lit("Unknown")).alias(col), *weight_of(df))
    return order_by_count(with_share(value_counts(filled, col), "n", 1), "n", col)


RATING_SIDES = (("Driver", "driver_rating"), ("Customer", "customer_rating"))


def ratings_distribution(df: DataFrame) -> DataFrame:
    """Exact ratings 1..5 per side, zero-filled, share of *all* rows (2 dp)."""
    # one aggregate: 5 counters per side plus the row total, then one row per cell
    cells, items = [], []
    for t, c in RATING_SIDES:
        for r in range(1, 6):
            name = f"_{t}{r}"
            cells.append(F.count(F.when(F.col(c).cast("double") == F.lit(float(r)), F.lit(1))).alias(name))
            items.append(F.struct(F.lit(t).alias("type"), F.lit(r).alias("rating"), F.col(name).alias("n")))
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *cells)
    out = wide.select("_total", F.inline(F.array(*items)))
    pct = pround(F.try_divide(F.col("n").cast("double"), F.col("_total").cast("double")) * F.lit(100.0), 2)
    return out.select("type", "rating", "n", pct.alias("pct"))


def _unrated(c: str) -> F.Column:
    return F.coalesce(F.col(c) == F.lit(-1.0), F.lit(False))


def low_rating_share(df: DataFrame) -> DataFrame:
    """Share of exact 1/2/3 ratings among rated rows, both sides."""
    out = []
    for t, c in RATING_SIDES:
        low = F.count(F.when(F.col(c).isin(1.0, 2.0, 3.0), 1))
        rated_n = F.count(F.when(~_unrated(c), 1))
        out.append(pround(low / F.greatest(rated_n, F.lit(1)) * 100.0, P).alias(f"{t.lower()}_le3_pct"))
    return df.agg(*out)


def ratings_kpis(df: DataFrame) -> DataFrame:
    """Average over rated rows (2 dp, NULL when none) and unrated share (1 dp)."""
    out = []
    for t, c in RATING_SIDES:
        out.append(pround(F.avg(F.when(~_unrated(c), F.col(c))), 2).alias(f"{t.lower()}_avg"))
        out.append(pround(F.avg(as_flag(_unrated(c))) * F.lit(100.0), 1).alias(f"{t.lower()}_unrated_pct"))
    return df.agg(*out)


def uplift(df: DataFrame, low: float = 0.08, high: float = 0.13, col: str = "booking_value") -> DataFrame:
    """Baseline revenue = mean USD value × rides; low/high uplift per year and month.

    One pass: the mean over valid (numeric, ≥ 0, not NaN) values and the row
    count are one aggregate."""
    v = numeric(df, col)
    usd = F.when((v >= 0) & ~F.isnan(v), v * F.lit(INR_TO_USD))
    k = df.agg(F.count(F.lit(1)).alias("total_rides"), F.avg(usd).alias("_avg"))
    base = F.col("_avg") * F.col("total_rides")
    return k.select(
        "total_rides",
        pround("_avg", P).alias("avg_usd"),
        pround(base, P).alias("baseline"),
        pround(base * F.lit(low), P).alias("uplift_low"),
        pround(base * F.lit(high), P).alias("uplift_high"),
        pround(base * F.lit(low) / F.lit(12.0), P).alias("month_low"),
        pround(base * F.lit(high) / F.lit(12.0), P).alias("month_high"),
    )


# ---------------------------------------------------------------------------
# R10 region hot spots and heat-maps
# ---------------------------------------------------------------------------
def top_locations(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Top-k non-null locations by rides."""
    s = df.select(F.col(col).cast("string").alias("location"), *weight_of(df))
    return top_k(value_counts(s, "location", dropna=True), "n", k, "location")


def heatmap_topzone_hour(df: DataFrame, k: int = 10, zone: str = "pickup_location") -> DataFrame:
    """Top-k pickup zones × 24 hours, zero-filled, with ``zone_rank``.

    One pass over the rows: a single aggregate per zone holds its total (all
    rows, any hour) and a counter per hour; top-k and ranks are taken from that
    table (one row per zone).
    """
    from pyspark.sql import Window

    z = df.select(F.col(zone).cast("string").alias("location"), numeric(df, "hour").alias("hour"), *weight_of(df)) \
        .where(F.col("location").isNotNull())
    hours = [n_rows(z, F.floor("hour") == h).alias(c) for h, c in enumerate(hour_columns())]
    # rows with an hour outside 0..23 count for the total only
    z = z.withColumn("hour", F.when(F.col("hour").between(0, 23), F.col("hour")))
    per = z.groupBy("location").agg(n_rows(z).alias("n"), *hours)
    # k rows: rank them in one small window
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("location").asc()))
    return top_k(per, "n", k, "location").select(rank.alias("zone_rank"), "location", *hour_columns())


# ---------------------------------------------------------------------------
# R11 service quality
# ---------------------------------------------------------------------------
def service_frame(df: DataFrame, h1: int | None = None, h2: int | None = None,
                  vtat: str = "avg_vtat") -> DataFrame:
    d = df.withColumns({"_v": numeric(df, vtat), "_h": numeric(df, "hour")})
    d = d.where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v")) & F.col("_h").between(0, 23))
    if h1 is not None:
        d = d.where(F.col("_h") >= F.lit(h1))
    if h2 is not None:
        d = d.where(F.col("_h") <= F.lit(h2))
    return d


def service_quality(df: DataFrame, h1: int | None = None, h2: int | None = None,
                    approx: bool = False) -> DataFrame:
    """Median VTAT, % pickups ≤ 10 min and rides within the hour range (A43) –
    the counts ride along in the median's first pass."""
    d = service_frame(df, h1, h2)
    k = exact_percentiles(d, "_v", {"m": 0.5}, approx=approx, extra={
        "n": F.count, "le10": lambda v: F.avg(as_flag(v <= 10)) * F.lit(100.0)})
    return k.select("n", pround("m", P).alias("median_vtat"), pround("le10", P).alias("pct_le_10"))


def service_bins(df: DataFrame, h1: int | None = None, h2: int | None = None) -> DataFrame:
    """Pickup-wait histogram, trailing empty bins trimmed."""
    d = service_frame(df, h1, h2)
    return axis_counts(d, bin_index("_v", BN.WAIT_EDGES), BN.WAIT_LABELS, "rides", trim_trailing=True)


def zone_service(df: DataFrame, h1: int | None = None, h2: int | None = None) -> DataFrame:
    """Per pickup zone: mean VTAT, rides, mean coordinates."""
    d = service_frame(df, h1, h2).withColumns(
        {"_lat": numeric(df, "pickup_latitude"), "_lon": numeric(df, "pickup_longitude")}
    ).where(F.col("pickup_location").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
    return d.groupBy("pickup_location").agg(
        pround(F.avg("_v"), P).alias("avg_vtat"),
        F.count("pickup_location").alias("rides"),
        pround(F.avg("_lat"), P).alias("lat"),
        pround(F.avg("_lon"), P).alias("lon"),
    )


# ---------------------------------------------------------------------------
# R12 revenue structure
# ---------------------------------------------------------------------------
def revenue_frame(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Rows with a positive value, a zone and an hour in 0..23."""
    d = df.select(
        numeric(df, "booking_value").cast("double").alias("booking_value"),
        F.col("pickup_location"),
        numeric(df, "hour").alias("hour"),
    ).dropna()
    d = d.where(F.col("hour").between(0, 23) & (F.col("booking_value") > 0)).withColumn(
        "hour", F.col("hour").cast("int"))
    if zone is not None:
        d = d.where(F.col("pickup_location") == F.lit(zone))
    return d


def zone_kpis(df: DataFrame, zone: str | None = None, by_zone: bool = True, approx: bool = False,
              few_zones: bool = False) -> DataFrame:
    """Mean, median, % in $0–5 (closed) per zone, or overall (A41) – one pass for
    the aggregates and the median's sketch. ``few_zones``: the caller has counted
    the zone dimension, so a row per zone may be broadcast and the fact rows are
    not shuffled by zone."""
    d = revenue_frame(df, zone)
    keys = ["pickup_location"] if by_zone else None
    k = exact_percentiles(d, "booking_value", {"median_usd": 0.5}, by=keys, approx=approx, bounded_groups=few_zones, extra={
        "rides": F.count, "avg_usd": F.avg,
        "pct_0_5": lambda v: F.avg(as_flag(between(v, 0, 5))) * F.lit(100.0)})
    return k.select(*(keys or []), "rides", pround("avg_usd", P).alias("avg_usd"),
                    pround("pct_0_5", P).alias("pct_0_5"), pround("median_usd", P).alias("median_usd"))


def revenue_groups(df: DataFrame, *keys: str, zone: str | None = None) -> DataFrame:
    """(keys, revenue, rides) of the revenue frame; of counted rows, from their sums."""
    if not weight_of(df):
        return revenue_frame(df, zone).groupBy(*keys).agg(
            F.sum("booking_value").alias("revenue"), F.count(F.lit(1)).alias("rides"))
    d = df.where(F.col("pickup_location").isNotNull() & F.col("hour").between(0, 23) & (F.col("_fares") > 0))
    if zone is not None:
        d = d.where(F.col("pickup_location") == F.lit(zone))
    return d.groupBy(*keys).agg(F.sum("_revenue").alias("revenue"), F.sum("_fares").alias("rides"))


def revenue_by_zone(df: DataFrame, k: int = 10) -> DataFrame:
    """Top-k zones by total revenue with rank."""
    g = revenue_groups(df, "pickup_location")
    top = top_k(g, "revenue", k, "pickup_location")
    from pyspark.sql import Window

    # the window runs over the k rows of the top-k only, never over fact rows
    return top.select(
        F.row_number().over(Window.orderBy(F.col("revenue").desc(), F.col("pickup_location").asc())).alias("rank"),
        "pickup_location", pround("revenue", P).alias("revenue"),
    )


def top_zone_share(df: DataFrame, k: int = 5) -> DataFrame:
    """Revenue share of the top-k zones."""
    g = revenue_groups(df, "pickup_location")
    return top_n_share(g, "revenue", k, "pickup_location", out="top_share_pct").select(
        pround("top_share_pct", P).alias("top_share_pct"))


def revenue_value_bins(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Rides per USD bucket (values already USD), zero bins kept."""
    d = revenue_frame(df, zone)
    return axis_counts(d, bin_index("booking_value", BN.VALUE_USD_EDGES), BN.VALUE_USD_LABELS, "rides")


def arpu_by_hour(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Mean value per hour on the 24-hour axis, NULL where no rides."""
    g = revenue_groups(df, "hour", zone=zone)
    g = g.select(F.col("hour").cast("int").alias("hour"), (F.col("revenue") / F.col("rides")).alias("arpu"))
    spine = axis_frame(df.sparkSession, "hour", list(range(24)))
    return densify(g, spine, "hour").select("hour", pround("arpu", P).alias("arpu"))


def arpu_by_zone_hour(df: DataFrame) -> DataFrame:
    """Every zone at once: zone × ``h00..h23`` mean value, NULL where no rides."""
    g = revenue_groups(df, "pickup_location", "hour").withColumn("arpu", F.col("revenue") / F.col("rides"))
    p = pivot_hours(g, "pickup_location", F.max("arpu"), fill=None)
    return p.select("pickup_location", *[pround(h, P).alias(h) for h in hour_columns()])


def zone_options(df: DataFrame) -> DataFrame:
    """Distinct zones of the revenue frame, sorted."""
    return revenue_groups(df, "pickup_location").select("pickup_location").orderBy("pickup_location")


# ---------------------------------------------------------------------------
# R13 vehicle mix & trip length
# ---------------------------------------------------------------------------
def vehicle_mix(df: DataFrame) -> DataFrame:
    """Rides, mean fare, revenue and revenue in thousands per vehicle type."""
    d = df.select("vehicle_type", numeric(df, "booking_value").alias("v")).where(F.col("vehicle_type").isNotNull())
    g = d.groupBy("vehicle_type").agg(
        F.count("vehicle_type").alias("rides"), F.avg("v").alias("avg_fare"), F.sum("v").alias("revenue"))
    return g.select(
        "vehicle_type", "rides", pround("avg_fare", P).alias("avg_fare"),
        pround("revenue", P).alias("revenue"), pround(F.col("revenue") / F.lit(1000.0), P).alias("revenue_k"),
    )


def mix_kpis(df: DataFrame) -> DataFrame:
    """Top-3 vehicle share of rides and share of trips < 5 km.

    One pass: rides and short trips are counted per vehicle type (NULL type kept
    as its own group for the short-trip share); both KPIs come from those rows.
    """
    g = df.groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(numeric(df, "ride_distance") < 5, F.lit(1))).alias("short"))
    # one row per vehicle type: the largest three are taken from the gathered counts
    sizes = F.reverse(F.array_sort(F.collect_list(F.when(F.col("vehicle_type").isNotNull(), F.col("n")))))
    k = g.agg(sizes.alias("_sizes"), F.sum("n").alias("rows"), F.sum("short").alias("short"))
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    top3, typed = F.aggregate(F.slice("_sizes", 1, 3), zero, add), F.aggregate("_sizes", zero, add)
    return k.select(
        pround(F.coalesce(F.try_divide(top3.cast("double") * F.lit(100.0), typed.cast("double")),
                          F.lit(0.0)), P).alias("top3_pct"),
        pround(F.try_divide(F.col("short").cast("double"), F.col("rows").cast("double")) * F.lit(100.0), P)
        .alias("pct_lt_5km"),
    )


def distance_vs_wait_median(df: DataFrame, approx: bool = False) -> DataFrame:
    """Median VTAT per trip-length bin on the fixed axis."""
    t = trip_frame(df)
    m = BN.binned_median(t, "ride_distance", BN.TRIP_LENGTH_EDGES, BN.TRIP_LENGTH_LABELS, "avg_vtat",
                         out="median_vtat", approx=approx)
    return m.select("bin_idx", "label", pround("median_vtat", P).alias("median_vtat"))
