"""Profiling, text parsing, the cleaning job, feedback validation and the SQL
entry (R1, R15, X1–X11, P17, F9, S3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelens.functions import (
    MONTH_NAMES,
    WEEKDAY_ABBR,
    WEEKDAY_NAMES,
    fmt_currency,
    fmt_pct,
    fmt_thousands,
    min_sec,
    month_to_num,
    parse_hour,
    parse_weekday,
    stars,
    to_number,
)
from ridelens.operators import bins as BN
from ridelens.operators import clean as C
from ridelens.operators import common as CM
from ridelens.operators import profile as PF
from ridelens.operators import time as TM
from ridelens.plans.oracle_views import with_views
from ridelens.plans.registry import register
from ridelens.plans.sqltext import pr, share, values_table
from ridelens.schemas import CLEAN_SCHEMA, FEEDBACK_SCHEMA
from ridelens.session import scratch_path
from ridelens.sources.driver_views import bookings, bookings_raw, table
from ridelens.sources import batches as BT
from ridelens.sources.files import (
    append_feedback_batch,
    csv_rejects,
    export_csv,
    persist_table,
    read_bookings,
    read_feedback,
    sql_report,
    write_clean,
)

# Spark types of view B, in column order (what the profile reports).
B_TYPES = [
    ("month", "int"), ("day", "int"), ("weekday", "int"), ("hour", "int"),
    ("booking_id", "bigint"), ("booking_status", "string"), ("customer_id", "bigint"),
    ("vehicle_type", "string"), ("pickup_location", "string"), ("drop_location", "string"),
    ("avg_vtat", "double"), ("reason_for_cancelling_by_customer", "string"),
    ("driver_cancellation_reason", "string"), ("incomplete_rides_reason", "string"),
    ("booking_value", "double"), ("ride_distance", "double"), ("driver_rating", "double"),
    ("customer_rating", "double"), ("payment_method", "string"),
]

# ---------------------------------------------------------------------------
# R1 / R15 profile
# ---------------------------------------------------------------------------
_PROFILE_SQL = with_views(" UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS dtype, "
    f"CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) AS BIGINT) AS total, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM B"
    for i, (c, t) in enumerate(B_TYPES)))


@register("column_profile", _PROFILE_SQL)
def column_profile(spark, sf):
    """The view is stored first: the profile scans it column by column."""
    return PF.profile(persist_table(bookings(spark, sf), f"profile_input_{uuid.uuid4().hex[:12]}"))


_MISSING_SQL = with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing_n, "
    f"{pr(f'CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0', 4)} AS missing_pct FROM B"
    for c, _ in B_TYPES))


@register("missing_report", _MISSING_SQL)
def missing_report(spark, sf):
    return PF.missing_report(bookings(spark, sf))


@register("duplicate_count", with_views(
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM B)) AS BIGINT) AS n_duplicates FROM B"))
def duplicate_count(spark, sf):
    return PF.duplicate_count(bookings(spark, sf))


_TRIP_KEYS = ["vehicle_type", "pickup_location", "drop_location", "booking_status", "hour", "payment_method"]


@register("duplicate_trip_keys", with_views(
    f"""SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_TRIP_KEYS)} FROM B)) AS BIGINT)
               AS n_duplicates FROM B"""))
def duplicate_trip_keys(spark, sf):
    """Duplicates on a column subset (NULLs compare equal)."""
    return PF.duplicate_count(bookings(spark, sf), _TRIP_KEYS)


_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESCRIBE_SQL = with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, {pr(f'avg({c})', 4)} AS mean,
               {pr(f'stddev_samp({c})', 4)} AS std, CAST(min({c}) AS DOUBLE) AS min,
               {pr(f'quantile_cont({c}, 0.25)', 4)} AS q25, {pr(f'quantile_cont({c}, 0.5)', 4)} AS q50,
               {pr(f'quantile_cont({c}, 0.75)', 4)} AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
    for c in _DESCRIBE_COLS))


@register("describe", _DESCRIBE_SQL)
def describe(spark, sf):
    return PF.describe(table(spark, sf, "lineitem"), _DESCRIBE_COLS)


_CORR_COLS = ["avg_vtat", "booking_value", "ride_distance", "driver_rating", "customer_rating"]
_CORR_SQL = with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {pr(f'corr({a}, {b})', 6)} AS corr FROM B"
    for a in _CORR_COLS for b in _CORR_COLS))


@register("correlation", _CORR_SQL)
def correlation(spark, sf):
    return PF.correlation(bookings(spark, sf), _CORR_COLS)


_LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("correlation_lineitem", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {pr(f'corr({a}, {b})', 6)} AS corr FROM lineitem"
    for a in _LI_CORR for b in _LI_CORR)))
def correlation_lineitem(spark, sf):
    return PF.correlation(table(spark, sf, "lineitem"), _LI_CORR)


_HIST_SQL = with_views(
    f"""SELECT ax.bin_idx, {pr("st.lo + ax.bin_idx * ((st.hi - st.lo) / 30.0)", 6)} AS bin_lo,
               {pr("st.lo + (ax.bin_idx + 1) * ((st.hi - st.lo) / 30.0)", 6)} AS bin_hi,
               CAST(COALESCE(c.n, 0) AS BIGINT) AS n
        FROM ax CROSS JOIN st LEFT JOIN c ON ax.bin_idx = c.bin_idx""",
    """v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
    st AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
    c AS (SELECT CAST(CASE WHEN st.hi - st.lo = 0 THEN 0
                           ELSE least(floor((v.x - st.lo) * 30.0 / (st.hi - st.lo)), 29) END AS INTEGER) AS bin_idx,
                 count(*) AS n FROM v, st GROUP BY 1),
    ax AS (SELECT CAST(range AS INTEGER) AS bin_idx FROM range(30))""")


@register("equi_width_histogram", _HIST_SQL)
def equi_width_histogram(spark, sf):
    h = BN.equi_width_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)
    from ridelens.functions import pround

    return h.select("bin_idx", pround("bin_lo", 6).alias("bin_lo"), pround("bin_hi", 6).alias("bin_hi"), "n")


_BOX_SQL = with_views(
    f"""SELECT {pr("q.q1", 6)} AS q1, {pr("q.med", 6)} AS median, {pr("q.q3", 6)} AS q3, {pr("q.q3 - q.q1", 6)} AS iqr,
               {pr("q.q1 - 1.5 * (q.q3 - q.q1)", 6)} AS lower_fence, {pr("q.q3 + 1.5 * (q.q3 - q.q1)", 6)} AS upper_fence,
               min(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_low,
               max(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_high,
               CAST(count(*) FILTER (WHERE NOT (x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1)))
                    AS BIGINT) AS n_outliers,
               CAST(count(*) AS BIGINT) AS n
        FROM v, q GROUP BY q.q1, q.med, q.q3""",
    """v AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
    q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v)""")


@register("box_stats", _BOX_SQL)
def box_stats(spark, sf):
    from ridelens.functions import pround

    b = BN.box_stats(table(spark, sf, "lineitem"), "l_extendedprice")
    six = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    return b.select(*[pround(c, 6).alias(c) for c in six], "whisker_low", "whisker_high", "n_outliers", "n")


@register("table_shape", with_views("SELECT CAST(count(*) AS BIGINT) AS n_rows, 19 AS n_columns FROM B"))
def table_shape(spark, sf):
    return PF.table_shape(bookings(spark, sf))


# ---------------------------------------------------------------------------
# text parsing
# ---------------------------------------------------------------------------
def _hour_text(spark, sf):
    """B with an ``hour_text`` column written in every accepted form, and in forms that are no hour."""
    b = bookings(spark, sf).select("booking_id", "hour")
    h = F.col("hour").cast("int")
    h12 = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12).cast("string")
    hh = F.lpad(h.cast("string"), 2, "0")
    low, up = (F.when(h < 12, F.lit(a)).otherwise(F.lit(p)) for a, p in (("am", "pm"), ("AM", "PM")))
    forms = [h.cast("string"), F.concat(hh, F.lit(":00")), F.concat(h12, F.lit(" "), low), F.lit("xx"),
             F.concat(hh, F.lit(":30:15")), F.concat(h12, low), F.concat(h12, F.lit(":30"), up),
             F.concat(F.lit(" "), h12, F.lit(":30 "), low), F.lit("nan"), F.lit("Infinity"), F.lit("1e30"),
             F.lit(None).cast("string")]
    text = F.element_at(F.array(*forms), (F.col("booking_id") % len(forms) + 1).cast("int"))
    return b.select("booking_id", text.alias("hour_text"))


_HOUR_TEXT_SQL = """
hb AS (SELECT booking_id, CAST(hour AS INTEGER) AS h, booking_id % 12 AS f,
              CAST(CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END AS VARCHAR) AS h12,
              lpad(CAST(CAST(hour AS INTEGER) AS VARCHAR), 2, '0') AS hh,
              CASE WHEN hour < 12 THEN 'am' ELSE 'pm' END AS ap FROM B),
ht AS (SELECT booking_id, h, f,
              CASE f WHEN 0 THEN CAST(h AS VARCHAR) WHEN 1 THEN hh || ':00' WHEN 2 THEN h12 || ' ' || ap
                     WHEN 3 THEN 'xx' WHEN 4 THEN hh || ':30:15' WHEN 5 THEN h12 || ap
                     WHEN 6 THEN h12 || ':30' || upper(ap) WHEN 7 THEN ' ' || h12 || ':30 ' || ap
                     WHEN 8 THEN 'nan' WHEN 9 THEN 'Infinity' WHEN 10 THEN '1e30' END AS hour_text FROM hb)
"""


@register("parse_hour_text", with_views(
    """SELECT booking_id, hour_text, CASE WHEN f IN (0, 1, 2, 4, 5, 6, 7) THEN h END AS hour_parsed FROM ht""",
    _HOUR_TEXT_SQL))
def parse_hour_text(spark, sf):
    t = _hour_text(spark, sf)
    return t.withColumn("hour_parsed", parse_hour("hour_text"))


def _weekday_text(spark, sf):
    b = bookings(spark, sf).select("booking_id", "weekday")
    w = F.col("weekday")
    full = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), w + 1)
    abbr = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_ABBR]), w + 1)
    r = F.col("booking_id") % 8
    text = (F.when(r == 0, full)
            .when(r == 1, F.concat(F.lit(" "), F.lower(abbr), F.lit(" ")))
            .when(r == 2, w.cast("string"))
            .when(r == 3, F.upper(full)).when(r == 4, F.lit("nan")).when(r == 5, F.lit("-Infinity"))
            .when(r == 6, F.lit("1e30")).otherwise(F.lit("xx")))
    return b.select("booking_id", text.alias("weekday_text"))


@register("parse_weekday_text", with_views(
    """SELECT booking_id, CASE r WHEN 0 THEN full_name WHEN 1 THEN ' ' || lower(left(full_name, 3)) || ' '
                          WHEN 2 THEN CAST(w AS VARCHAR) WHEN 3 THEN upper(full_name) WHEN 4 THEN 'nan'
                          WHEN 5 THEN '-Infinity' WHEN 6 THEN '1e30' ELSE 'xx' END AS weekday_text,
              CASE WHEN r <= 3 THEN w END AS weekday_parsed
       FROM wt""",
    """wt AS (SELECT booking_id, booking_id % 8 AS r, CAST(weekday AS INTEGER) AS w,
              CASE weekday WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday'
                   WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' WHEN 6 THEN 'Sunday' END AS full_name FROM B)"""))
def parse_weekday_text(spark, sf):
    return _weekday_text(spark, sf).withColumn("weekday_parsed", parse_weekday("weekday_text"))


@register("rebase_weekday", with_views(
    f"""SELECT c.weekday, nm.weekday_name, CAST(n AS BIGINT) AS n, {share('n', '(SELECT sum(n) FROM c)', 1)} AS pct
        FROM c LEFT JOIN nm ON c.weekday = nm.weekday""",
    f"""t0 AS (SELECT CAST(hour AS INTEGER) AS h, CAST(weekday + 1 AS INTEGER) AS w, CAST(month AS INTEGER) AS m FROM B),
    t AS (SELECT CASE WHEN (SELECT min(w) FROM t0) >= 1 AND (SELECT max(w) FROM t0) <= 7 THEN w - 1
                      ELSE least(greatest(w, 0), 6) END AS weekday FROM t0),
    c AS (SELECT weekday, count(*) AS n FROM t GROUP BY 1),
    {values_table("nm", ["weekday", "weekday_name"], list(enumerate(WEEKDAY_NAMES)))}"""))
def rebase_weekday(spark, sf):
    """Weekday coded 1–7 (Monday = 1) is rebased to 0–6 before counting."""
    b = bookings(spark, sf).withColumn("weekday", F.col("weekday") + 1)
    return TM.demand_by(b, "weekday")


_MONTH_CASE = " ".join(f"WHEN '{m.lower()}' THEN {i + 1}" for i, m in enumerate(MONTH_NAMES))
_MONTH_ARR = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"


@register("parse_month_names", with_views(
    f"""SELECT CASE lower(trim(mt)) {_MONTH_CASE} END AS month_num, CAST(count(*) AS BIGINT) AS n
        FROM mo GROUP BY 1""",
    f"""mo AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN {_MONTH_ARR}[month(o_orderdate)]
                   WHEN 1 THEN '  ' || upper({_MONTH_ARR}[month(o_orderdate)]) || ' '
                   ELSE 'Month' || CAST(month(o_orderdate) AS VARCHAR) END AS mt FROM orders)"""))
def parse_month_names(spark, sf):
    """Order months written as names (plain, padded upper case, or junk) → 1–12."""
    o = table(spark, sf, "orders")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("o_orderdate"))
    r = F.col("o_orderkey") % 3
    text = (F.when(r == 0, name).when(r == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
            .otherwise(F.concat(F.lit("Month"), F.month("o_orderdate").cast("string"))))
    t = o.select(month_to_num(text).alias("month_num"))
    return t.groupBy("month_num").agg(F.count(F.lit(1)).alias("n"))


@register("vtat_min_sec", with_views(
    """SELECT booking_id, avg_vtat, minutes, seconds,
              CASE WHEN avg_vtat IS NULL THEN NULL WHEN minutes > 0 THEN printf('%d min %02d sec', minutes, seconds)
                   ELSE printf('%d sec', seconds) END AS label
       FROM (SELECT booking_id, avg_vtat,
                    CAST(tot // 60 AS BIGINT) AS minutes, CAST(tot % 60 AS BIGINT) AS seconds
             FROM (SELECT booking_id, avg_vtat,
                          CASE WHEN avg_vtat IS NOT NULL
                               THEN CAST(greatest(0.0, round_even(avg_vtat * 60.0, 0)) AS BIGINT) END AS tot
                   FROM B))"""))
def vtat_min_sec(spark, sf):
    b = bookings(spark, sf).select("booking_id", "avg_vtat")
    m = min_sec("avg_vtat")
    return b.select("booking_id", "avg_vtat", m["minutes"].alias("minutes"), m["seconds"].alias("seconds"),
                    m["label"].alias("label"))


# ---------------------------------------------------------------------------
# cleaning job (P17) and feedback
# ---------------------------------------------------------------------------
@register("clean_bookings", with_views("SELECT * FROM B_clean"))
def clean_bookings(spark, sf):
    return C.clean_bookings(bookings_raw(spark, sf))


def feedback_rows(spark, sf):
    """Feedback-shaped rows from ``conversations``: message = text, rating = turn,
    e-mail built from the conversation id (every 4th invalid, some blank); the
    rating comes as text, in places as no number at all."""
    cv = table(spark, sf, "conversations")
    cid = F.col("conv_id")
    email = (F.when(cid % 4 == 0, F.concat(F.lit("user"), cid.cast("string"), F.lit("@invalid")))
             .when(cid % 9 == 1, F.lit("   "))
             .otherwise(F.concat(F.lit("user"), cid.cast("string"), F.lit("@example.com"))))
    rating = (F.when(cid % 5 == 3, F.lit("nan")).when(cid % 7 == 5, F.lit("great")).when(cid % 11 == 2, F.lit("1e30"))
              .when(cid % 13 == 6, F.lit(None)).otherwise(F.concat(F.col("turn").cast("string"), F.lit(".7"))))
    return cv.select("conv_id", "turn", rating.alias("rating"),
                     F.col("text").alias("message"), email.alias("email"))


_WS = r"'\A\s+|\s+\z'"
_FB = f"""
fb AS (SELECT conv_id, turn, text AS message, conv_id % 5 = 3 OR conv_id % 7 = 5 OR conv_id % 11 = 2 AS bad_rating,
              CASE WHEN conv_id % 13 <> 6 THEN CAST(turn AS INTEGER) END AS rating,
              CASE WHEN conv_id % 4 = 0 THEN 'user' || CAST(conv_id AS VARCHAR) || '@invalid'
                   WHEN conv_id % 9 = 1 THEN '   '
                   ELSE 'user' || CAST(conv_id AS VARCHAR) || '@example.com' END AS email
       FROM conversations),
tg AS (SELECT *, regexp_replace(message, {_WS}, '', 'g') AS m2, regexp_replace(email, {_WS}, '', 'g') AS e2 FROM fb),
tr AS (SELECT *, CASE WHEN message IS NULL OR length(m2) = 0 THEN 'missing message'
                      WHEN email IS NULL OR length(e2) = 0 THEN 'missing email'
                      WHEN NOT regexp_matches(e2, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'invalid email'
                      WHEN bad_rating THEN 'invalid rating' END AS reason
       FROM tg)
"""


@register("feedback_valid", with_views(
    """SELECT conv_id, turn, CASE WHEN rating IS NOT NULL THEN CAST(least(greatest(rating, 1), 5) AS INTEGER) END AS rating, m2 AS message, e2 AS email
       FROM tr WHERE reason IS NULL""", _FB))
def feedback_valid(spark, sf):
    valid, _ = C.validate_feedback(feedback_rows(spark, sf))
    return valid


@register("feedback_rejected", with_views(
    "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM tr WHERE reason IS NOT NULL GROUP BY 1", _FB))
def feedback_rejected(spark, sf):
    _, rejected = C.validate_feedback(feedback_rows(spark, sf))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# S1, S4, S5 files: CSV by header names, rejects, the cleaned table
# ---------------------------------------------------------------------------
_CLEAN_TEXT_IDS = "SELECT * REPLACE (CAST(booking_id AS VARCHAR) AS booking_id, CAST(customer_id AS VARCHAR) AS customer_id) FROM B_clean"


def _shared(spark, name):
    """A fresh folder for an exported file in the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("csv_round_trip", with_views(_CLEAN_TEXT_IDS))
def csv_round_trip(spark, sf):
    """The cleaned table exported as CSV (S5) with a leaked index column in front and its columns in another
    order, read back by header names (S1)."""
    path, clean = _shared(spark, "clean-csv"), C.clean_bookings(bookings_raw(spark, sf))
    export_csv(clean.select(F.col("booking_id").alias("Unnamed: 0"), *reversed(clean.columns)), path)
    return read_bookings(spark, path, CLEAN_SCHEMA)


@register("csv_rejects", with_views(
    """SELECT 'month' AS column_name, CAST(0 AS BIGINT) AS n_rejected
       UNION ALL SELECT 'booking_value', CAST(count(*) FILTER (booking_id % 10 = 3) AS BIGINT) FROM B
       UNION ALL SELECT 'avg_vtat', CAST(count(*) FILTER (booking_id % 7 = 2) AS BIGINT) FROM B"""))
def csv_reject_counts(spark, sf):
    """Values of a CSV file that do not convert to the schema's type; missing values are no rejects."""
    b, path = bookings(spark, sf), _shared(spark, "dirty-csv")
    k = F.col("booking_id")
    text = {c: F.col(c).cast("string") for c in ("month", "booking_value", "avg_vtat")}
    value = F.when(k % 10 == 3, "12,5").when(k % 10 == 4, "NaN").otherwise(text["booking_value"])
    wait = F.when(k % 7 == 2, "soon").when(k % 7 == 3, "").otherwise(text["avg_vtat"])
    export_csv(b.select(F.concat(text["month"], F.lit(".0")).alias("month"), value.alias("booking_value"),
                        wait.alias("avg_vtat")), path)
    fields = [f for f in CLEAN_SCHEMA.fields if f.name in text]
    return csv_rejects(spark, path, StructType(fields))


@register("clean_table_by_month", with_views(
    "SELECT month, CAST(count(*) AS BIGINT) AS n, round(sum(booking_value), 4) AS total FROM B_clean GROUP BY month"))
def clean_table_by_month(spark, sf):
    """The cleaned table persisted by month (S4) and read back."""
    path = _shared(spark, "clean-table")
    write_clean(C.clean_bookings(bookings_raw(spark, sf)), path)
    t = read_bookings(spark, path, fmt="parquet")
    return t.groupBy(F.col("month").cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("booking_value"), 4).alias("total"))


# ---------------------------------------------------------------------------
# S3 SQL entry with a bound table parameter
# ---------------------------------------------------------------------------
@register("sql_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def sql_count(spark, sf):
    return sql_report(
        spark,
        "SELECT COUNT(*) AS n FROM IDENTIFIER(:t)",
        args={"t": "ridelens_lineitem"},
        views={"ridelens_lineitem": table(spark, sf, "lineitem")},
    )


# raw column → its SQL over the fixture view (CTAT and the three flags exist in the raw layout only)
_RAW_NUMERIC = {
    "Avg VTAT": "avg_vtat", "Booking Value": "booking_value", "Ride Distance": "ride_distance",
    "Driver Ratings": "driver_rating", "Customer Rating": "customer_rating",
    "Avg CTAT": "CASE WHEN booking_status = 'Completed' THEN 10 + ((booking_id * 43) % 400) / CAST(10 AS DOUBLE) END",
    "Cancelled Rides by Customer": "CASE WHEN booking_status = 'Cancelled by Customer' THEN CAST(1 AS DOUBLE) END",
    "Cancelled Rides by Driver": "CASE WHEN booking_status = 'Cancelled by Driver' THEN CAST(1 AS DOUBLE) END",
    "Incomplete Rides": "CASE WHEN booking_status = 'Incomplete' THEN CAST(1 AS DOUBLE) END",
    "Nothing": "CAST(NULL AS DOUBLE)",
}
_DESCRIBE_B_SQL = with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count(v) AS BIGINT) AS count, {pr('avg(v)', 4)} AS mean,
               {pr('stddev_samp(v)', 4)} AS std, CAST(min(v) AS DOUBLE) AS min, {pr('quantile_cont(v, 0.25)', 4)} AS q25,
               {pr('quantile_cont(v, 0.5)', 4)} AS q50, {pr('quantile_cont(v, 0.75)', 4)} AS q75,
               CAST(max(v) AS DOUBLE) AS max FROM (SELECT {e} AS v FROM B)"""
    for c, e in _RAW_NUMERIC.items()))


@register("describe_bookings", _DESCRIBE_B_SQL)
def describe_bookings(spark, sf):
    """Numeric summary of the nine numeric raw columns and of one without any value (NULLs skipped per column)."""
    raw = bookings_raw(spark, sf).withColumn("Nothing", F.lit(None).cast("double"))
    return PF.describe(raw, list(_RAW_NUMERIC))


_RAW_FLAGS = ["Cancelled Rides by Customer", "Cancelled Rides by Driver", "Incomplete Rides"]
_FLAG_STATUS = {"Cancelled Rides by Customer": "Cancelled by Customer",
                "Cancelled Rides by Driver": "Cancelled by Driver", "Incomplete Rides": "Incomplete"}
_RAW_FLAG_SQL = with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, flag AS value, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT CASE WHEN booking_status = '{_FLAG_STATUS[c]}' THEN CAST(1 AS DOUBLE) END AS flag FROM B)
        GROUP BY flag""" for c in _RAW_FLAGS))


@register("raw_flag_counts", _RAW_FLAG_SQL)
def raw_flag_counts(spark, sf):
    """Value counts (NULL kept) of the raw cancellation / incomplete flag columns,
    all three in one aggregate over the raw layout."""
    raw = bookings_raw(spark, sf)
    long = raw.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in _RAW_FLAGS
    ])))
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# helpers on the given tables (P7, P8, P13, P19, X6, X13, the no_valid rule)
# ---------------------------------------------------------------------------
@register("lenient_numbers", with_views(
    """SELECT booking_id, CASE booking_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN ride_distance
                               WHEN 3 THEN NULL ELSE avg_vtat END AS number FROM B"""))
def lenient_numbers(spark, sf):
    """Text coerced to numbers: what is no number is NULL."""
    k, text = F.col("booking_id") % 5, {c: F.col(c).cast("string") for c in ("ride_distance", "avg_vtat")}
    v = (F.when(k == 0, "n/a").when(k == 1, "nan").when(k == 2, text["ride_distance"]).when(k == 3, "1,234")
         .otherwise(F.concat(F.lit(" "), text["avg_vtat"])))
    return bookings(spark, sf).select("booking_id", to_number(v).alias("number"))


@register("reason_categories", with_views(
    """SELECT COALESCE(reason_for_cancelling_by_customer, 'nan') AS customer, COALESCE(driver_cancellation_reason, 'nan')
              AS driver, CAST(count(*) AS BIGINT) AS n FROM B_clean GROUP BY 1, 2"""))
def reason_categories(spark, sf):
    """Missing reasons as a category of their own."""
    cols = {"reason_for_cancelling_by_customer": "customer", "driver_cancellation_reason": "driver"}
    b = C.null_as_category(C.clean_bookings(bookings_raw(spark, sf)).select(*cols), cols)
    return C.display_names(b, cols).groupBy("customer", "driver").agg(F.count(F.lit(1)).alias("n"))


@register("unrated_counts", with_views(
    """SELECT driver_rating = -1 AS "Driver unrated", customer_rating = -1 AS "Customer unrated",
              CAST(count(*) AS BIGINT) AS "Rides" FROM B_clean GROUP BY 1, 2"""))
def unrated_counts(spark, sf):
    """Unrated flags (P13) under presentation names."""
    b = C.with_unrated_flags(C.clean_bookings(bookings_raw(spark, sf)))
    g = b.groupBy("driver_unrated", "customer_unrated").agg(F.count(F.lit(1)).alias("rides"))
    return C.display_names(g, {"driver_unrated": "Driver unrated", "customer_unrated": "Customer unrated",
                               "rides": "Rides"})


@register("rebased_heatmap", with_views(
    """SELECT 'weekday' AS rebased, CAST(6 AS INTEGER) AS weekday, hour, CAST(count(*) AS BIGINT) AS n FROM B GROUP BY hour
       UNION ALL SELECT 'hour', weekday, CAST(0 AS INTEGER), CAST(count(*) AS BIGINT) FROM B GROUP BY weekday
       UNION ALL SELECT 'no value valid', weekday, hour, CAST(count(*) AS BIGINT) FROM B WHERE weekday = 6 GROUP BY 2, 3"""))
def rebased_heatmap(spark, sf):
    """An axis whose values are all out of range is rebased, the other one is left as it is (X6): weekday coded 7 for all
    rows with their hours, hour coded 24 for all rows with their weekdays; and the Sundays, coded 7, with their hours."""
    b = bookings(spark, sf).select("weekday", "hour")
    coded = {"weekday": b.withColumn("weekday", F.lit(7)), "hour": b.withColumn("hour", F.lit(24)),
             "no value valid": b.where("weekday = 6").withColumn("weekday", F.col("weekday") + 1)}
    out = None
    for name, rows in coded.items():
        t = TM.heatmap_time_frame(TM.normalize_hour(TM.normalize_weekday(rows, "weekday", rule="no_valid")))
        t = t.select(F.lit(name).alias("rebased"), F.col("weekday").cast("int").alias("weekday"),
                     F.col("hour").cast("int").alias("hour"), F.col("_n").alias("n"))
        out = t if out is None else out.unionByName(t)
    return out


_HEAVY = "CASE WHEN booking_id % 3 = 0 THEN customer_id % 12 ELSE customer_id + booking_id % 100 END"


@register("heavy_values", with_views(
    f"""SELECT 'skewed' AS kind, v AS value, n FROM (SELECT {_HEAVY} AS v, CAST(count(*) AS BIGINT) AS n FROM B GROUP BY 1
          ORDER BY n DESC, v LIMIT 10)
        UNION ALL SELECT 'even', v, n FROM (SELECT customer_id AS v, CAST(count(*) AS BIGINT) AS n FROM B GROUP BY 1
          ORDER BY n DESC, v LIMIT 10)"""))
def heavy_values(spark, sf):
    """Ten most frequent values of a skewed key with many values (candidates and their recount) and of an even one, whose
    proof fails (full count) (A2, A38)."""
    b = bookings(spark, sf).select("booking_id", "customer_id", F.expr(_HEAVY).alias("value"))
    even = CM.top_values(b.select(F.col("customer_id").alias("value")), "value", 10)
    both = {"skewed": CM.top_values(b, "value", 10), "even": even}
    parts = [d.select(F.lit(k).alias("kind"), F.col("value").cast("long").alias("value"), "n") for k, d in both.items()]
    return parts[0].unionByName(parts[1])


@register("feedback_appended_once", with_views(
    """SELECT CASE WHEN rating IS NOT NULL THEN CAST(least(greatest(rating, 1), 5) AS INTEGER) END AS rating,
              m2 AS message, e2 AS email, 'b' || CAST(conv_id % 3 AS VARCHAR) AS batch
       FROM tr WHERE reason IS NULL""", _FB))
def feedback_appended_once(spark, sf):
    """Three batches of feedback: one sent once, one sent twice, one whose first writer died before its commit."""
    folder = scratch_path(spark, f"feedback-{uuid.uuid4().hex[:12]}")
    rows = feedback_rows(spark, sf)
    for k, sent in enumerate((1, 2, 1)):
        batch = rows.where(F.col("conv_id") % 3 == k)
        if k == 2:
            valid, _ = C.validate_feedback(batch)
            BT.stage_batch(C.with_ingest_time(valid).select(*FEEDBACK_SCHEMA.names), folder, "b2")
        for _ in range(sent):
            append_feedback_batch(batch, folder, f"b{k}")
    return read_feedback(spark, folder).select("rating", "message", "email", "batch")


@register("formatted_zones", with_views(
    """SELECT pickup_location, format('{:,}', CAST(count(*) * 1000 AS BIGINT)) AS rides_text,
              '$' || format('{:,.2f}', CAST(count(*) AS DOUBLE) * 12.5) AS money_text,
              format('{:.1f}', CAST(count(*) % 97 AS DOUBLE) + 0.2) || '%' AS pct_text,
              repeat('★', CAST(count(*) % 6 AS INTEGER)) AS stars FROM B GROUP BY pickup_location"""))
def formatted_zones(spark, sf):
    """Thousands, currency, per cent and star texts."""
    g = bookings(spark, sf).groupBy("pickup_location").agg(F.count(F.lit(1)).alias("n"))
    return g.select("pickup_location", fmt_thousands(F.col("n") * 1000).alias("rides_text"),
                    fmt_currency(F.col("n") * 12.5).alias("money_text"),
                    fmt_pct(F.col("n") % 97 + 0.2).alias("pct_text"), stars(F.col("n") % 6).alias("stars"))
