"""Projections, row-wise cleaning and row filters.

All of these are narrow (map-only) transformations: they add projections and
filters that Catalyst pushes into the scan, and never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions import (
    EMAIL_PATTERN,
    clip,
    date_parts,
    hour_of_time_text,
    is_blank,
    numeric,
    strip_ws,
    to_int,
)
from ridelens.schemas import CLEAN_COLUMNS, CLEAN_FILL, CLEAN_NAMES

INR_TO_USD = 0.011  # fixed value: the reference's conversion rate
INDEX_COLUMNS = ("Unnamed: 0", "_c0")  # row index leaked by a pandas CSV writer


# ---------------------------------------------------------------------------
# column lookup and guards
# ---------------------------------------------------------------------------
def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present in ``df`` (exact name first, then case-insensitive)."""
    cols = df.columns
    for c in candidates:
        if c in cols:
            return c
    lower = {c.lower(): c for c in cols}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return None


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    """Raise ``ValueError`` naming the missing columns."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


# ---------------------------------------------------------------------------
# projections
# ---------------------------------------------------------------------------
def standardize_columns(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename raw spaced names to snake_case (P2); absent names are skipped."""
    mapping = {k: v for k, v in (names or CLEAN_NAMES).items() if k in df.columns}
    return df.withColumnsRenamed(mapping)


def drop_columns(df: DataFrame, cols: Iterable[str], strict: bool = False) -> DataFrame:
    """Drop columns (P3); ``strict`` raises on an absent name like pandas does."""
    cols = list(cols)
    if strict:
        require_columns(df, cols)
    return df.drop(*cols)


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Remove a leaked row-index column (``Unnamed: 0`` / ``_c0``)."""
    return df.drop(*[c for c in INDEX_COLUMNS if c in df.columns])


def to_usd(df: DataFrame, col: str, rate: float = INR_TO_USD, out: str | None = None) -> DataFrame:
    """INR → USD."""
    return df.withColumn(out or col, F.col(col) * F.lit(rate))


def null_as_category(df: DataFrame, cols: Iterable[str], token: str = "nan") -> DataFrame:
    """Cast to string, NULL → ``token`` as its own level."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in cols})


def fill_missing(df: DataFrame, policy: dict | None = None) -> DataFrame:
    """Per-column constant fill (P9); defaults to the cleaning job's policy."""
    pol = {k: v for k, v in (policy or CLEAN_FILL).items() if k in df.columns}
    return df.fillna(pol)


def na_drop(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows NULL in any of ``subset`` (P10)."""
    return df.dropna(subset=list(subset))


def with_unrated_flags(df: DataFrame, driver: str = "driver_rating",
                       customer: str = "customer_rating", sentinel: float = -1.0) -> DataFrame:
    """``driver_unrated`` / ``customer_unrated`` = rating equals the sentinel."""
    return df.withColumns(
        {
            "driver_unrated": F.coalesce(F.col(driver) == F.lit(sentinel), F.lit(False)),
            "customer_unrated": F.coalesce(F.col(customer) == F.lit(sentinel), F.lit(False)),
        }
    )


def display_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Presentation names on a finished table (P19) – last step only."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# ---------------------------------------------------------------------------
# the cleaning job
# ---------------------------------------------------------------------------
def clean_bookings(raw: DataFrame, date_col: str = "Date", time_col: str = "Time") -> DataFrame:
    """Raw bookings → the 19-column clean table, one narrow projection chain.

    Date → month/day/weekday (0=Monday), Time ``HH:mm:ss`` → hour, keep the used
    columns, snake_case names, then the fill policy (values 0, ratings −1,
    payment ``"No payment"``; reasons stay NULL).
    """
    parts = date_parts(date_col)
    df = drop_index_columns(raw).withColumns(
        {
            "month": parts["month"],
            "day": parts["day"],
            "weekday": parts["weekday"],
            "hour": hour_of_time_text(time_col),
        }
    )
    df = standardize_columns(df)
    df = df.select(*CLEAN_COLUMNS)
    for c in ("avg_vtat", "booking_value", "ride_distance", "driver_rating", "customer_rating"):
        df = df.withColumn(c, numeric(df, c).cast("double"))
    return fill_missing(df)


# ---------------------------------------------------------------------------
# filters (F1, F2, F10, F11)
# ---------------------------------------------------------------------------
def valid_amount(df: DataFrame, col: str, min_value: float = 0.0, strict: bool = False) -> DataFrame:
    """Keep rows whose ``col`` is a number ``>= min_value`` (``> `` when strict).

    The column is coerced leniently first (text that is not a number is dropped).
    """
    v = numeric(df, col)
    cond = v > F.lit(min_value) if strict else v >= F.lit(min_value)
    # NaN sorts above every number in Spark; the comparison conjunct still reaches the scan
    return df.withColumn(col, v).where(cond & ~F.isnan(v))


def rated(df: DataFrame, col: str, sentinel: float = -1.0) -> DataFrame:
    """Exclude the unrated sentinel."""
    return df.where(F.col(col) != F.lit(sentinel))


def hour_range(df: DataFrame, h1: int | None = None, h2: int | None = None, col: str = "hour") -> DataFrame:
    """User hour range (F4); no bound = the observed min/max, i.e. no filter."""
    c = F.col(col)
    if h1 is not None:
        df = df.where(c >= F.lit(h1))
    if h2 is not None:
        df = df.where(c <= F.lit(h2))
    return df


# ---------------------------------------------------------------------------
# feedback validation
# ---------------------------------------------------------------------------
def validate_feedback(df: DataFrame, message: str = "message", email: str = "email",
                      rating: str = "rating") -> tuple[DataFrame, DataFrame]:
    """Split feedback rows into (valid, rejected).

    Checks in the reference's order: blank message, blank e-mail, e-mail format; then a
    rating that is there but no number (the reference's widget cannot produce one).
    Valid rows are trimmed and the rating is clamped to 1–5; rejected rows carry
    a ``reason``.
    """
    msg, mail = F.col(message), F.col(email)
    reason = (
        F.when(is_blank(msg), F.lit("missing message"))
        .when(is_blank(mail), F.lit("missing email"))
        .when(~strip_ws(mail).rlike(EMAIL_PATTERN), F.lit("invalid email"))
        .when(F.col(rating).isNotNull() & to_int(rating).isNull(), F.lit("invalid rating"))
    )
    tagged = df.withColumn("reason", reason)
    valid = tagged.where(F.col("reason").isNull()).drop("reason").withColumns(
        {
            message: strip_ws(msg),
            email: strip_ws(mail),
            rating: clip(to_int(rating), 1, 5).cast("int"),
        }
    )
    rejected = tagged.where(F.col("reason").isNotNull())
    return valid, rejected


def with_ingest_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Stamp rows with the current UTC time."""
    return df.withColumn(col, F.current_timestamp())
