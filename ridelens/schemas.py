"""Fixed table schemas and the data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw column names and their descriptions, in the source order.
# ---------------------------------------------------------------------------
RAW_DICTIONARY = [
    ("Date", "Date of the booking"),
    ("Time", "Time of the booking"),
    ("Booking ID", "Unique identifier for each ride booking"),
    ("Booking Status", "Status of booking (Completed, Cancelled by Customer, Cancelled by Driver, etc.)"),
    ("Customer ID", "Unique identifier for customers"),
    ("Vehicle Type", "Type of vehicle (Go Mini, Go Sedan, Auto, eBike/Bike, UberXL, Premier Sedan)"),
    ("Pickup Location", "Starting location of the ride"),
    ("Drop Location", "Destination location of the ride"),
    ("Avg VTAT", "Average time for driver to reach pickup location (in minutes)"),
    ("Avg CTAT", "Average trip duration from pickup to destination (in minutes)"),
    ("Cancelled Rides by Customer", "Customer-initiated cancellation flag"),
    ("Reason for cancelling by Customer", "Reason for customer cancellation"),
    ("Cancelled Rides by Driver", "Driver-initiated cancellation flag"),
    ("Driver Cancellation Reason", "Reason for driver cancellation"),
    ("Incomplete Rides", "Incomplete ride flag"),
    ("Incomplete Rides Reason", "Reason for incomplete rides"),
    ("Booking Value", "Total fare amount for the ride"),
    ("Ride Distance", "Distance covered during the ride (in km)"),
    ("Driver Ratings", "Rating given to driver (1-5 scale)"),
    ("Customer Rating", "Rating given by customer (1-5 scale)"),
    ("Payment Method", "Method used for payment (UPI, Cash, Credit Card, Uber Wallet, Debit Card)"),
]

_RAW_TYPES = {
    "Avg VTAT": T.DoubleType(),
    "Avg CTAT": T.DoubleType(),
    "Cancelled Rides by Customer": T.DoubleType(),
    "Cancelled Rides by Driver": T.DoubleType(),
    "Incomplete Rides": T.DoubleType(),
    "Booking Value": T.DoubleType(),
    "Ride Distance": T.DoubleType(),
    "Driver Ratings": T.DoubleType(),
    "Customer Rating": T.DoubleType(),
}

RAW_SCHEMA = T.StructType(
    [
        T.StructField(name, _RAW_TYPES.get(name, T.StringType()), True, {"comment": desc})
        for name, desc in RAW_DICTIONARY
    ]
)

# Fixed value: raw name → clean snake_case name (the 19 kept columns).
CLEAN_NAMES = {
    "Booking ID": "booking_id",
    "Booking Status": "booking_status",
    "Customer ID": "customer_id",
    "Vehicle Type": "vehicle_type",
    "Pickup Location": "pickup_location",
    "Drop Location": "drop_location",
    "Avg VTAT": "avg_vtat",
    "Reason for cancelling by Customer": "reason_for_cancelling_by_customer",
    "Driver Cancellation Reason": "driver_cancellation_reason",
    "Incomplete Rides Reason": "incomplete_rides_reason",
    "Booking Value": "booking_value",
    "Ride Distance": "ride_distance",
    "Driver Ratings": "driver_rating",
    "Customer Rating": "customer_rating",
    "Payment Method": "payment_method",
}

# Columns of the cleaned table, in order, and their types.
CLEAN_COLUMNS = [
    "month", "day", "weekday", "hour",
    "booking_id", "booking_status", "customer_id", "vehicle_type",
    "pickup_location", "drop_location", "avg_vtat",
    "reason_for_cancelling_by_customer", "driver_cancellation_reason", "incomplete_rides_reason",
    "booking_value", "ride_distance", "driver_rating", "customer_rating", "payment_method",
]

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("weekday", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("booking_id", T.StringType()),
        T.StructField("booking_status", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("pickup_location", T.StringType()),
        T.StructField("drop_location", T.StringType()),
        T.StructField("avg_vtat", T.DoubleType()),
        T.StructField("reason_for_cancelling_by_customer", T.StringType()),
        T.StructField("driver_cancellation_reason", T.StringType()),
        T.StructField("incomplete_rides_reason", T.StringType()),
        T.StructField("booking_value", T.DoubleType()),
        T.StructField("ride_distance", T.DoubleType()),
        T.StructField("driver_rating", T.DoubleType()),
        T.StructField("customer_rating", T.DoubleType()),
        T.StructField("payment_method", T.StringType()),
    ]
)

# Fixed value: null policy of the cleaning job.
CLEAN_FILL = {
    "avg_vtat": 0.0,
    "booking_value": 0.0,
    "ride_distance": 0.0,
    "driver_rating": -1.0,
    "customer_rating": -1.0,
    "payment_method": "No payment",
}

LOCATION_SCHEMA = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("pickup_location", T.StringType()),
        T.StructField("drop_location", T.StringType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("vehicle_type", T.StringType()),
    ]
)

FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)


def data_dictionary(spark: SparkSession) -> DataFrame:
    """(column, description) table of the raw bookings schema."""
    return spark.createDataFrame(RAW_DICTIONARY, "column_name string, description string")
