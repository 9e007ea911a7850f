"""Time-of-day / weekday / month normalisation and demand tables.

Normalisation rules that depend on the *whole* column (rebase 1–7 → 0–6 only
when every value is in 1..7) read the column's min/max through a scalar
subquery: a one-row partial aggregate, no join and no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import (
    WEEKDAY_ABBR,
    clip,
    month_name,
    numeric,
    parse_hour,
    parse_weekday,
    to_int,
    weekday_name,
)
from ridelens.operators.common import axis_frame, densify, n_rows, scalars, weight_of, with_share


def normalize_weekday(df: DataFrame, col: str = "weekday", rule: str = "minmax") -> DataFrame:
    """Rebase a 1–7 weekday coding to 0–6.

    ``rule="minmax"``: subtract 1 from every row when min ≥ 1 and max ≤ 7,
    otherwise clip to 0–6 (the demand tab). ``rule="no_valid"``: subtract 1 from
    the rows in 1..7 only when no value at all lies in 0..6 (the heat-map tab).
    """
    c = F.col(col)
    if rule == "minmax":
        st = scalars(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")), "lo", "hi")
        lo, hi = st["lo"], st["hi"]
        rebase = (lo >= 1) & (hi <= 7)
        return df.withColumn(col, F.when(rebase, c - 1).otherwise(clip(c, 0, 6)).cast("int"))
    if rule == "no_valid":
        fl = scalars(df.agg(
            F.max(F.when(c.between(1, 7), 1).otherwise(0)).alias("any17"),
            F.max(F.when(c.between(0, 6), 1).otherwise(0)).alias("any06"),
        ), "any17", "any06")
        shift = (fl["any17"] == 1) & (fl["any06"] == 0)
        return df.withColumn(col, F.when(shift & c.between(1, 7), c - 1).otherwise(c))
    raise ValueError(f"unknown rule {rule!r}")


def normalize_hour(df: DataFrame, col: str = "hour") -> DataFrame:
    """Rebase 1–24 → 0–23 (``% 24``) only when no value lies in 0..23."""
    c = F.col(col)
    fl = scalars(df.agg(
        F.max(F.when(c.between(1, 24), 1).otherwise(0)).alias("any124"),
        F.max(F.when(c.between(0, 23), 1).otherwise(0)).alias("any023"),
    ), "any124", "any023")
    shift = (fl["any124"] == 1) & (fl["any023"] == 0)
    return df.withColumn(col, F.when(shift & c.between(1, 24), F.pmod(c, F.lit(24))).otherwise(c))


def time_counts(df: DataFrame) -> DataFrame:
    """Rows per (hour, weekday, month) after the demand tab's normalisation, in ONE
    pass over the rows: the rows are counted per raw key first (a small table,
    ≤ 24 × weekdays × 12), and the global weekday rule is read from that table,
    so the fact rows are never scanned a second time for it."""
    t = df.select(
        numeric(df, "hour").alias("hour"),
        numeric(df, "weekday").alias("weekday"),
        numeric(df, "month").alias("month"),
        *weight_of(df),
    ).dropna()
    t = t.select(
        clip(to_int("hour"), 0, 23).alias("hour"),
        to_int("weekday").alias("weekday"),
        clip(to_int("month"), 1, 12).alias("month"),
        *weight_of(df),
    )
    g = t.groupBy("hour", "weekday", "month").agg(n_rows(t).alias("_n"))
    return normalize_weekday(g, "weekday", "minmax")


def demand_by(df: DataFrame, unit: str, digits: int = 1) -> DataFrame:
    """Rides per hour / weekday / month with share and names (A14). Observed values only."""
    g = time_counts(df).groupBy(unit).agg(F.sum("_n").alias("n"))
    g = with_share(g, "n", digits)
    if unit == "weekday":
        g = g.withColumn("weekday_name", weekday_name("weekday"))
    elif unit == "month":
        g = g.withColumn("month_name", month_name("month"))
    return g


def demand_kpis(df: DataFrame) -> DataFrame:
    """Average rides per hour (rounded), busiest hour (lowest on ties) and its count."""
    g = time_counts(df).groupBy("hour").agg(F.sum("_n").alias("n"))
    return g.agg(
        F.rint(F.avg("n")).alias("avg_rides_per_hour"),
        F.min_by("hour", F.struct((-F.col("n")).alias("nn"), F.col("hour").alias("h"))).alias("busiest_hour"),
        F.max("n").alias("busiest_n"),
    )


def rate_of(df: DataFrame, preds: dict, digits: int | None = None) -> DataFrame:
    """One pass, one row: ``100 * share of rows where predicate`` for each named
    predicate; NULL counts as false and every row is in the denominator (A6)."""
    from ridelens.functions import as_flag, pround

    out = []
    for name, pred in preds.items():
        share = F.avg(as_flag(pred)) if not weight_of(df) else F.try_divide(
            n_rows(df, pred).cast("double"), n_rows(df).cast("double"))
        v = share * F.lit(100.0)
        out.append((pround(v, digits) if digits is not None else v).alias(name))
    return df.agg(*out)


def peak_shares(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Peak (7–11, 16–20) and night (0–5) shares of all rows."""
    from ridelens.functions import NIGHT_HOURS, PEAK_HOURS

    h = F.col(hour)
    return rate_of(df, {"peak_pct": h.isin(*PEAK_HOURS), "night_pct": h.isin(*NIGHT_HOURS)})


def heatmap_time_frame(df: DataFrame, weekday: str = "weekday", hour: str = "hour") -> DataFrame:
    """Heat-map normalisation: parse numbers or names, rebase 1–7 / 1–24 codings
    (``no_valid`` rules), keep 0..6 × 0..23. Returns rides per (weekday, hour).

    One pass over the rows: they are counted per parsed (weekday, hour) first;
    both global rules are read from that small table (a window over its rows)
    and applied to it.
    """
    from pyspark.sql import Window

    t = df.select(parse_weekday(weekday).alias("weekday"), parse_hour(hour).alias("hour"), *weight_of(df))
    g = t.groupBy("weekday", "hour").agg(n_rows(t).alias("_n"))
    w, h = F.col("weekday"), F.col("hour")
    whole = Window.partitionBy()  # one row per (weekday, hour) value

    def any_in(c, lo, hi):
        return F.max(F.when(c.between(lo, hi), 1).otherwise(0)).over(whole)

    g = g.select("*", any_in(w, 1, 7).alias("w17"), any_in(w, 0, 6).alias("w06"), any_in(h, 1, 24).alias("h124"),
                 any_in(h, 0, 23).alias("h023"))
    fl = {c: F.col(c) for c in ("w17", "w06", "h124", "h023")}
    g = g.select(
        F.when((fl["w17"] == 1) & (fl["w06"] == 0) & w.between(1, 7), w - 1).otherwise(w).alias("weekday"),
        F.when((fl["h124"] == 1) & (fl["h023"] == 0) & h.between(1, 24), F.pmod(h, F.lit(24))).otherwise(h)
        .alias("hour"),
        "_n",
    )
    return g.dropna().where(F.col("weekday").between(0, 6) & F.col("hour").between(0, 23))


def hour_columns(prefix: str = "h") -> list[str]:
    return [f"{prefix}{h:02d}" for h in range(24)]


def pivot_hours(df: DataFrame, row_key: str, value=None, fill=0) -> DataFrame:
    """``row_key`` × 24 hour columns ``h00..h23`` (count, or ``value`` aggregate).

    Explicit pivot values avoid Spark's extra distinct job; the pivot is a
    partial aggregate keyed by ``(row_key, hour)``.
    """
    agg = F.count(F.lit(1)) if value is None else value
    p = df.groupBy(row_key).pivot("hour", list(range(24))).agg(agg)
    p = p.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})
    if fill is not None:
        p = p.fillna(fill, subset=hour_columns())
    return p


def heatmap_weekday_hour(df: DataFrame) -> DataFrame:
    """7 × 24 ride counts, every cell zero-filled."""
    t = heatmap_time_frame(df)
    p = pivot_hours(t, "weekday", F.sum("_n"))
    spine = axis_frame(df.sparkSession, "weekday", list(range(7)), WEEKDAY_ABBR, label_col="weekday_name")
    return densify(p, spine, "weekday", {h: 0 for h in hour_columns()}).select(
        "weekday", "weekday_name", *hour_columns()
    )
