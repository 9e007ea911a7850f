"""Location lookups and region scoping.

The location dimension is reduced to one row per lower-cased name and joined
with a plain left equi-join. No broadcast hint is forced: the reduced dimension
is an aggregate, so Spark knows its size – it is broadcast when it fits under
``spark.sql.autoBroadcastJoinThreshold`` (statically or by AQE at runtime) and
otherwise shuffled, with AQE's skew-join handling a hot location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import pround
from ridelens.operators.clean import INR_TO_USD

# Fixed value: our default region box (lat 28.0–29.1, lon 76.5–77.9).
DEFAULT_BBOX = (28.0, 29.1, 76.5, 77.9)


def location_lookup(locations: DataFrame, name: str = "location", lat: str = "latitude",
                    lon: str = "longitude", order_col: str | None = None) -> DataFrame:
    """One row per ``lower(name)``: ``(_lkey, _lat, _lon)``.

    Several rows with the same lower-cased name: the first by ``order_col`` wins
    (a file line number gives the reference's "first match"); without it, the
    smallest name, then smallest coordinates – deterministic on any partitioning.
    """
    order = F.struct(*([F.col(order_col)] if order_col else []), F.col(name), F.col(lat), F.col(lon))
    best = F.min_by(F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")), order)
    return (
        locations.select(name, lat, lon, *([order_col] if order_col else []))
        .groupBy(F.lower(F.col(name)).alias("_lkey"))
        .agg(best.alias("_ll"))
        .select("_lkey", F.col("_ll.lat").alias("_lat"), F.col("_ll.lon").alias("_lon"))
    )


def file_order(locations: DataFrame) -> str | None:
    """The file-order column that :func:`ridelens.sources.files.read_locations` adds, if it is there."""
    return "_line" if "_line" in locations.columns else None


def geocode(df: DataFrame, lookup: DataFrame, name_col: str, prefix: str,
            default: float | None = None) -> DataFrame:
    """Attach ``{prefix}_latitude`` / ``{prefix}_longitude`` by case-insensitive name.

    Unknown name or NULL coordinate → ``default`` (``0.0`` reproduces the scorer,
    ``None`` keeps NULL for analytics).
    """
    lk = lookup.select(
        F.col("_lkey").alias(f"_{prefix}_k"),
        F.col("_lat").alias(f"{prefix}_latitude"),
        F.col("_lon").alias(f"{prefix}_longitude"),
    )
    out = df.join(lk, F.lower(F.col(name_col)) == F.col(f"_{prefix}_k"), "left").drop(f"_{prefix}_k")
    if default is not None:
        out = out.fillna({f"{prefix}_latitude": default, f"{prefix}_longitude": default})
    return out


def enrich_pickup_drop(df: DataFrame, locations: DataFrame, default: float | None = None,
                       pickup: str = "pickup_location", drop: str = "drop_location") -> DataFrame:
    """Pickup and drop coordinates (J2) from one reduced lookup."""
    lk = location_lookup(locations, order_col=file_order(locations))
    return geocode(geocode(df, lk, pickup, "pickup", default), lk, drop, "drop", default)


def in_bbox(lat: str, lon: str, bbox=DEFAULT_BBOX):
    lat_lo, lat_hi, lon_lo, lon_hi = bbox
    return F.col(lat).between(lat_lo, lat_hi) & F.col(lon).between(lon_lo, lon_hi)


def region_bookings(clean: DataFrame, locations: DataFrame, bbox=DEFAULT_BBOX,
                    rate: float | None = INR_TO_USD, value_col: str = "booking_value") -> DataFrame:
    """Bookings whose pickup *and* drop fall in ``bbox``, values in USD."""
    geo = enrich_pickup_drop(clean, locations)
    out = geo.where(in_bbox("pickup_latitude", "pickup_longitude", bbox)
                    & in_bbox("drop_latitude", "drop_longitude", bbox))
    if rate is not None:
        out = out.withColumn(value_col, F.col(value_col) * F.lit(rate))
    return out


def region_share(all_rows: DataFrame, region: DataFrame) -> DataFrame:
    """One row: total rows, region rows, region share %."""
    n_all = all_rows.agg(F.count(F.lit(1))).scalar()
    n_reg = region.agg(F.count(F.lit(1))).scalar()
    spark = all_rows.sparkSession
    return spark.range(1).select(
        n_all.alias("total_all"),
        n_reg.alias("total_region"),
        pround(F.try_divide(n_reg.cast("double"), F.greatest(n_all.cast("double"), F.lit(1.0))) * F.lit(100.0), 4)
        .alias("region_pct"),
    )


def region_share_one_pass(clean: DataFrame, locations: DataFrame, bbox=DEFAULT_BBOX) -> DataFrame:
    """:func:`region_share` in one pass: geocode once, count all rows and the rows
    whose pickup and drop both fall in ``bbox`` in one aggregate."""
    geo = enrich_pickup_drop(clean, locations)
    inside = in_bbox("pickup_latitude", "pickup_longitude", bbox) & in_bbox("drop_latitude", "drop_longitude", bbox)
    k = geo.agg(F.count(F.lit(1)).alias("total_all"), F.count(F.when(inside, F.lit(1))).alias("total_region"))
    return k.select(
        "total_all", "total_region",
        pround(F.try_divide(F.col("total_region").cast("double"),
                            F.greatest(F.col("total_all").cast("double"), F.lit(1.0))) * F.lit(100.0), 4)
        .alias("region_pct"),
    )


def semi_top_k(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among the top-k keys (J3); ``top`` has k rows → broadcast."""
    return df.join(F.broadcast(top.select(key)), key, "left_semi")


def route_points(scored: DataFrame) -> DataFrame:
    """Pickup/drop point pairs with all four coordinates known and non-zero."""
    cols = ["pickup_latitude", "pickup_longitude", "drop_latitude", "drop_longitude"]
    cond = None
    for c in cols:
        ok = F.col(c).isNotNull() & (F.col(c) != 0)
        cond = ok if cond is None else cond & ok
    return scored.where(cond)
