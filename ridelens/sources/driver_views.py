"""Bookings-shaped views derived from the driver's TPC-H-like tables.

``bookings(spark, sf_dir)`` is view ``B`` of FIXTURES.md §3: one booking per
``events`` row, enriched through ``customer`` and ``nation``. All derivations are
column expressions over a single scan of ``events``; the only joins are
``events ⋈ customer`` (planned by Catalyst/AQE from table statistics – it is a
sort-merge join once ``customer`` outgrows the broadcast threshold, with AQE
splitting a hot ``user_id``) and two lookups into ``nation``, which is a fixed
25-row table and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.schemas import CLEAN_FILL

# ---------------------------------------------------------------------------
# Fixed values of the fixture derivation (FIXTURES.md §3).
# ---------------------------------------------------------------------------
VEHICLE_TYPES = ["Auto", "Go Mini", "Go Sedan", "Bike", "Premier Sedan", "eBike", "Uber XL"]
PAYMENT_METHODS = ["UPI", "Cash", "Credit Card", "Uber Wallet", "Debit Card"]
CUSTOMER_REASONS = ["Wrong Address", "Change of plans", "Driver asked to cancel", "Driver not moving", "Other"]
DRIVER_REASONS = ["Vehicle issue", "Customer related issue", "Personal reasons", "Too many passengers"]
INCOMPLETE_REASONS = ["Customer Demand", "Vehicle Breakdown", "Other Issue"]
# status by m = (event_id * 7919) % 100: <62, <80, <87, <94, rest
STATUS_CUTS = [
    (62, "Completed"),
    (80, "Cancelled by Driver"),
    (87, "Cancelled by Customer"),
    (94, "No Driver Found"),
]
STATUS_REST = "Incomplete"
# location view: null coordinates / out-of-region keys
NULL_COORD_KEYS = [7, 13]
OUT_OF_REGION_KEYS = [3, 11]
OUT_OF_REGION_POINT = (51.5, -0.1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + F.lit(1))


def _status(m: Column) -> Column:
    expr = None
    for cut, label in STATUS_CUTS:
        expr = F.when(m < cut, F.lit(label)) if expr is None else expr.when(m < cut, F.lit(label))
    return expr.otherwise(F.lit(STATUS_REST))


def bookings(spark: SparkSession, sf_dir: str, keep_ts: bool = False) -> DataFrame:
    """View ``B``: raw-style nulls, clean column names (FIXTURES.md §3).

    ``keep_ts`` also returns the event timestamp ``ts`` (for the raw layout).
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation is the fixed 25-row TPC-H dimension: broadcast. Both lookups use the
    # same plan so the broadcast exchange is built once and reused.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))

    eid = F.col("event_id")
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).try_cast("int")
    st = F.col("booking_status")
    done = st.isin("Completed", "Incomplete")
    base = ev.select(
        "event_id", "ts", "user_id", "value",
        k.alias("k"),
    ).withColumn("booking_status", _status(eid * F.lit(7919) % F.lit(100)))

    with_cust = base.join(cust, base.user_id == cust.c_custkey, "left")
    p = nation.alias("p")
    d = nation.alias("d")
    joined = (
        with_cust.join(p, F.col("c_nationkey") == F.col("p.n_nationkey"), "left")
        .join(d, F.col("k") % F.lit(25) == F.col("d.n_nationkey"), "left")
        .select(*with_cust.columns, F.col("p.n_name").alias("pickup_location"),
                F.col("d.n_name").alias("drop_location"))
    )
    tenth = F.lit(10).cast("double")
    extra = ["ts"] if keep_ts else []
    return joined.select(
        F.month("ts").cast("int").alias("month"),
        F.dayofmonth("ts").cast("int").alias("day"),
        F.weekday("ts").cast("int").alias("weekday"),
        F.hour("ts").cast("int").alias("hour"),
        eid.alias("booking_id"),
        st.alias("booking_status"),
        F.col("user_id").alias("customer_id"),
        _pick(VEHICLE_TYPES, (F.col("user_id") + F.col("k")) % F.lit(7)).alias("vehicle_type"),
        "pickup_location",
        "drop_location",
        F.when(st != "No Driver Found", F.lit(2) + (eid * F.lit(37) % F.lit(180)) / tenth).alias("avg_vtat"),
        F.when(st == "Cancelled by Customer", _pick(CUSTOMER_REASONS, eid * F.lit(31) % F.lit(5)))
        .alias("reason_for_cancelling_by_customer"),
        F.when(st == "Cancelled by Driver", _pick(DRIVER_REASONS, eid * F.lit(31) % F.lit(4)))
        .alias("driver_cancellation_reason"),
        F.when(st == "Incomplete", _pick(INCOMPLETE_REASONS, eid * F.lit(31) % F.lit(3)))
        .alias("incomplete_rides_reason"),
        F.when(done, F.col("value") * F.lit(12)).alias("booking_value"),
        F.when(done, (F.col("k") + F.lit(1)) * F.lit(0.5)).alias("ride_distance"),
        F.when(st == "Completed", F.lit(1) + (eid * F.lit(13) % F.lit(41)) / tenth).alias("driver_rating"),
        F.when(st == "Completed", F.lit(1) + (eid * F.lit(17) % F.lit(41)) / tenth).alias("customer_rating"),
        F.when(done, _pick(PAYMENT_METHODS, eid * F.lit(29) % F.lit(5))).alias("payment_method"),
        *extra,
    )


def bookings_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``B_clean``: ``B`` after the cleaning job's fill policy."""
    return bookings(spark, sf_dir).fillna(CLEAN_FILL)


def bookings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``B`` in the raw 21-column layout (``Date``/``Time`` text, spaced names)."""
    b = bookings(spark, sf_dir, keep_ts=True)
    st = F.col("booking_status")
    one = F.lit(1.0)
    return b.select(
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.col("booking_id").alias("Booking ID"),
        st.alias("Booking Status"),
        F.col("customer_id").alias("Customer ID"),
        F.col("vehicle_type").alias("Vehicle Type"),
        F.col("pickup_location").alias("Pickup Location"),
        F.col("drop_location").alias("Drop Location"),
        F.col("avg_vtat").alias("Avg VTAT"),
        F.when(st == "Completed", F.lit(10) + (F.col("booking_id") * F.lit(43) % F.lit(400)) / F.lit(10.0))
        .alias("Avg CTAT"),
        F.when(st == "Cancelled by Customer", one).alias("Cancelled Rides by Customer"),
        F.col("reason_for_cancelling_by_customer").alias("Reason for cancelling by Customer"),
        F.when(st == "Cancelled by Driver", one).alias("Cancelled Rides by Driver"),
        F.col("driver_cancellation_reason").alias("Driver Cancellation Reason"),
        F.when(st == "Incomplete", one).alias("Incomplete Rides"),
        F.col("incomplete_rides_reason").alias("Incomplete Rides Reason"),
        F.col("booking_value").alias("Booking Value"),
        F.col("ride_distance").alias("Ride Distance"),
        F.col("driver_rating").alias("Driver Ratings"),
        F.col("customer_rating").alias("Customer Rating"),
        F.col("payment_method").alias("Payment Method"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``L``: a location dimension over ``nation`` (FIXTURES.md §3)."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    lat = (F.lit(2840) + key).cast("double") / F.lit(100.0)
    lon = (F.lit(7700) + key).cast("double") / F.lit(100.0)
    null_c = key.isin(*NULL_COORD_KEYS)
    out_c = key.isin(*OUT_OF_REGION_KEYS)
    return n.select(
        F.col("n_name").alias("location"),
        F.when(null_c, F.lit(None).cast("double")).when(out_c, F.lit(OUT_OF_REGION_POINT[0])).otherwise(lat)
        .alias("latitude"),
        F.when(null_c, F.lit(None).cast("double")).when(out_c, F.lit(OUT_OF_REGION_POINT[1])).otherwise(lon)
        .alias("longitude"),
    )
