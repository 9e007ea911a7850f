"""DuckDB text of the fixture views ``B``, ``B_clean``, ``B_region`` and ``L``.

Used only by the independent SQL oracle (``oracle_sql()``): each oracle query is
``ORACLE_PREFIX`` followed by its own SELECT. The derivation is written from
FIXTURES.md §3 separately from the Spark code in ``sources/driver_views.py``.
"""

from __future__ import annotations

_B = """
ev AS (
  SELECT e.event_id, e.ts, e.user_id, e.value,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN (e.event_id * 7919) % 100 < 62 THEN 'Completed'
              WHEN (e.event_id * 7919) % 100 < 80 THEN 'Cancelled by Driver'
              WHEN (e.event_id * 7919) % 100 < 87 THEN 'Cancelled by Customer'
              WHEN (e.event_id * 7919) % 100 < 94 THEN 'No Driver Found'
              ELSE 'Incomplete' END AS st
  FROM events e
),
B_ts AS (
  SELECT CAST(month(ev.ts) AS INTEGER) AS month,
         CAST(day(ev.ts) AS INTEGER) AS day,
         CAST(isodow(ev.ts) - 1 AS INTEGER) AS weekday,
         CAST(hour(ev.ts) AS INTEGER) AS hour,
         ev.event_id AS booking_id,
         ev.st AS booking_status,
         ev.user_id AS customer_id,
         CASE (ev.user_id + ev.k) % 7 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Go Mini' WHEN 2 THEN 'Go Sedan'
              WHEN 3 THEN 'Bike' WHEN 4 THEN 'Premier Sedan' WHEN 5 THEN 'eBike' ELSE 'Uber XL' END AS vehicle_type,
         p.n_name AS pickup_location,
         d.n_name AS drop_location,
         CASE WHEN ev.st = 'No Driver Found' THEN NULL
              ELSE 2 + ((ev.event_id * 37) % 180) / CAST(10 AS DOUBLE) END AS avg_vtat,
         CASE WHEN ev.st = 'Cancelled by Customer' THEN
              CASE (ev.event_id * 31) % 5 WHEN 0 THEN 'Wrong Address' WHEN 1 THEN 'Change of plans'
                   WHEN 2 THEN 'Driver asked to cancel' WHEN 3 THEN 'Driver not moving' ELSE 'Other' END
         END AS reason_for_cancelling_by_customer,
         CASE WHEN ev.st = 'Cancelled by Driver' THEN
              CASE (ev.event_id * 31) % 4 WHEN 0 THEN 'Vehicle issue' WHEN 1 THEN 'Customer related issue'
                   WHEN 2 THEN 'Personal reasons' ELSE 'Too many passengers' END
         END AS driver_cancellation_reason,
         CASE WHEN ev.st = 'Incomplete' THEN
              CASE (ev.event_id * 31) % 3 WHEN 0 THEN 'Customer Demand' WHEN 1 THEN 'Vehicle Breakdown'
                   ELSE 'Other Issue' END
         END AS incomplete_rides_reason,
         CASE WHEN ev.st IN ('Completed', 'Incomplete') THEN ev.value * 12 END AS booking_value,
         CASE WHEN ev.st IN ('Completed', 'Incomplete') THEN (ev.k + 1) * CAST(0.5 AS DOUBLE) END AS ride_distance,
         CASE WHEN ev.st = 'Completed' THEN 1 + ((ev.event_id * 13) % 41) / CAST(10 AS DOUBLE) END AS driver_rating,
         CASE WHEN ev.st = 'Completed' THEN 1 + ((ev.event_id * 17) % 41) / CAST(10 AS DOUBLE) END AS customer_rating,
         CASE WHEN ev.st IN ('Completed', 'Incomplete') THEN
              CASE (ev.event_id * 29) % 5 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Cash' WHEN 2 THEN 'Credit Card'
                   WHEN 3 THEN 'Uber Wallet' ELSE 'Debit Card' END
         END AS payment_method,
         ev.ts AS ts
  FROM ev
  LEFT JOIN customer c ON ev.user_id = c.c_custkey
  LEFT JOIN nation p ON c.c_nationkey = p.n_nationkey
  LEFT JOIN nation d ON ev.k % 25 = d.n_nationkey
),
B AS (SELECT * EXCLUDE (ts) FROM B_ts),
B_clean AS (
  SELECT month, day, weekday, hour, booking_id, booking_status, customer_id, vehicle_type,
         pickup_location, drop_location,
         COALESCE(avg_vtat, CAST(0 AS DOUBLE)) AS avg_vtat,
         reason_for_cancelling_by_customer, driver_cancellation_reason, incomplete_rides_reason,
         COALESCE(booking_value, CAST(0 AS DOUBLE)) AS booking_value,
         COALESCE(ride_distance, CAST(0 AS DOUBLE)) AS ride_distance,
         COALESCE(driver_rating, CAST(-1 AS DOUBLE)) AS driver_rating,
         COALESCE(customer_rating, CAST(-1 AS DOUBLE)) AS customer_rating,
         COALESCE(payment_method, 'No payment') AS payment_method
  FROM B
),
L AS (
  SELECT n_name AS location,
         CASE WHEN n_nationkey IN (7, 13) THEN NULL WHEN n_nationkey IN (3, 11) THEN CAST(51.5 AS DOUBLE)
              ELSE CAST(2840 + n_nationkey AS DOUBLE) / 100 END AS latitude,
         CASE WHEN n_nationkey IN (7, 13) THEN NULL WHEN n_nationkey IN (3, 11) THEN CAST(-0.1 AS DOUBLE)
              ELSE CAST(7700 + n_nationkey AS DOUBLE) / 100 END AS longitude
  FROM nation
),
L1 AS (
  SELECT lower(location) AS lkey, arg_min(latitude, location) AS latitude, arg_min(longitude, location) AS longitude
  FROM L GROUP BY lower(location)
),
B_geo AS (
  SELECT b.*, pu.latitude AS pickup_latitude, pu.longitude AS pickup_longitude,
         dr.latitude AS drop_latitude, dr.longitude AS drop_longitude
  FROM B_clean b
  LEFT JOIN L1 pu ON lower(b.pickup_location) = pu.lkey
  LEFT JOIN L1 dr ON lower(b.drop_location) = dr.lkey
),
B_region AS (
  SELECT month, day, weekday, hour, booking_id, booking_status, customer_id, vehicle_type,
         pickup_location, drop_location, avg_vtat,
         reason_for_cancelling_by_customer, driver_cancellation_reason, incomplete_rides_reason,
         booking_value * CAST(0.011 AS DOUBLE) AS booking_value,
         ride_distance, driver_rating, customer_rating, payment_method,
         pickup_latitude, pickup_longitude, drop_latitude, drop_longitude
  FROM B_geo
  WHERE pickup_latitude BETWEEN 28.0 AND 29.1 AND pickup_longitude BETWEEN 76.5 AND 77.9
    AND drop_latitude BETWEEN 28.0 AND 29.1 AND drop_longitude BETWEEN 76.5 AND 77.9
)
"""

ORACLE_PREFIX = "WITH " + _B.strip() + "\n"


def with_views(select_sql: str, extra_ctes: str = "") -> str:
    """``WITH <fixture views>[, extra] <select>``."""
    if extra_ctes:
        return ORACLE_PREFIX + ", " + extra_ctes.strip() + "\n" + select_sql.strip()
    return ORACLE_PREFIX + select_sql.strip()
