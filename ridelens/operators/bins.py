"""Histograms on fixed right-closed bins.

Bins are labelled with an ordered ``bin_idx`` so every output sorts by the
axis, not by the label text. Aggregates are keyed by ``bin_idx`` and hence
bounded by the number of bins, which is what allows their broadcast into the
axis spine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import bin_label, bin_index, pround
from ridelens.operators.common import axis_counts, axis_frame, box_row, densify, exact_percentiles, scalars, with_share

INF = float("inf")

# ---------------------------------------------------------------------------
# Bin edges and labels used by the reference's panels.
# ---------------------------------------------------------------------------
VALUE_USD_EDGES = [0, 5, 10, 15, 20, INF]
VALUE_USD_LABELS = ["$0–5", "$6–10", "$11–15", "$16–20", ">$20"]
DISTANCE_EDGES = [0, 5, 10, 15, 20, 30, 50, 100, INF]
DISTANCE_LABELS = ["0–5", "6–10", "11–15", "16–20", "21–30", "31–50", "51–100", "100+"]
VTAT_EDGES = [0, 5, 10, 15, 20, 30, 45, 60, 120, INF]
VTAT_LABELS = ["0–5", "6–10", "11–15", "16–20", "21–30", "31–45", "46–60", "61–120", "120+"]
WAIT_EDGES = [0, 5, 10, 15, 20, INF]
WAIT_LABELS = ["0–5", "6–10", "11–15", "16–20", ">20"]
TRIP_LENGTH_EDGES = [0, 3, 7, 12, 20, INF]
TRIP_LENGTH_LABELS = ["0–3", "3–7", "7–12", "12–20", ">20"]


def bin_spine(spark, labels: Sequence[str], idx: str = "bin_idx", label: str = "label") -> DataFrame:
    return axis_frame(spark, idx, list(range(len(labels))), labels, label_col=label)


def with_bin(df: DataFrame, col: str, edges: Sequence[float], idx: str = "bin_idx") -> DataFrame:
    return df.withColumn(idx, bin_index(col, edges))


def binned_counts(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str],
                  digits: int = 2, n: str = "n", pct: str = "pct") -> DataFrame:
    """Labelled histogram on the full axis, zero bins kept.

    Share denominator is ``max(rows of df, 1)`` – rows outside every bin count in
    the denominator but in no bin, as in the reference.
    """
    out = axis_counts(df, bin_index(col, edges), labels, n, extra={"_total": F.count(F.lit(1))})
    den = F.greatest(F.col("_total").cast("double"), F.lit(1.0))
    return out.select("bin_idx", "label", n,
                      pround(F.try_divide(F.col(n).cast("double"), den) * F.lit(100.0), digits).alias(pct))


def binned_summary(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str],
                   means: dict[str, tuple[str, int]], digits: int = 1, n: str = "n",
                   pct: str = "pct") -> DataFrame:
    """Per-bin count, rounded means and share, *used bins only*.

    ``means`` maps output name → (source column, digits). Rows outside every
    bin are excluded from counts and from the share denominator. With a handful
    of bins this is one global aggregate (a count and the means per bin as
    conditional aggregates, plus the binned total), turned into one row per bin
    – no keyed shuffle, no join, no second pass.
    """
    b = df.select(bin_index(col, edges).alias("_ix"), *[F.col(src).alias(f"_m_{name}")
                                                         for name, (src, _) in means.items()])
    aggs = [F.count(F.col("_ix")).alias("_total")]
    for i in range(len(labels)):
        hit = F.col("_ix") == F.lit(i)
        aggs.append(F.count(F.when(hit, F.lit(1))).alias(f"_c{i}"))
        aggs += [F.avg(F.when(hit, F.col(f"_m_{name}"))).alias(f"_a{i}_{name}") for name in means]
    wide = b.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("bin_idx"), F.lit(lbl).alias("label"), F.col(f"_c{i}").alias(n),
                 *[F.col(f"_a{i}_{name}").alias(name) for name in means])
        for i, lbl in enumerate(labels)
    ])
    out = wide.select("_total", F.inline(rows)).where(F.col(n) > 0)
    raw_share = F.try_divide(F.col(n).cast("double"), F.col("_total").cast("double")) * F.lit(100.0)
    share = pround(raw_share, digits) if digits is not None else raw_share
    return out.select("bin_idx", "label", n,
                      *[(pround(name, d) if d is not None else F.col(name)).alias(name)
                        for name, (_, d) in means.items()],
                      share.alias(pct))


def joint_histogram(df: DataFrame, x: str, x_edges, x_labels, y: str, y_edges, y_labels,
                    n: str = "n") -> DataFrame:
    """Counts over all pairs of *used* x-bins × used y-bins, zero cells kept.

    One pass: an aggregate keyed by ``(x_idx, y_idx)``, gathered into one row (at
    most one entry per cell of the fixed bin grid). The used bins, the grid and
    the labels are made from that row – no join.
    """
    b = df.select(bin_index(x, x_edges).alias("x"), bin_index(y, y_edges).alias("y"))
    cells = b.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    row = cells.agg(F.collect_list(F.struct("x", "y", "c")).alias("cells"))
    whole = F.filter("cells", lambda e: e["x"].isNotNull() & e["y"].isNotNull())
    counted = F.map_from_entries(F.transform(whole, lambda e: F.struct(F.struct(e["x"], e["y"]), e["c"])))
    row = row.select(F.array_distinct(F.array_compact("cells.x")).alias("xs"),
                     F.array_distinct(F.array_compact("cells.y")).alias("ys"), counted.alias("m"))
    grid = row.select("ys", "m", F.explode("xs").alias("x_idx")).select(
        "m", "x_idx", F.explode("ys").alias("y_idx"))
    return grid.select(
        "x_idx", bin_label("x_idx", x_labels).alias("x_label"), "y_idx", bin_label("y_idx", y_labels).alias("y_label"),
        F.coalesce(F.try_element_at("m", F.struct(F.col("x_idx").alias("x"), F.col("y_idx").alias("y"))), F.lit(0).cast("long")).alias(n))


def binned_median(df: DataFrame, col: str, edges, labels, value: str, out: str = "median",
                  approx: bool = False) -> DataFrame:
    """Median of ``value`` per bin of ``col`` on the full axis; empty bin → NULL."""
    spark = df.sparkSession
    binned = with_bin(df.select(col, value), col, edges).where(F.col("bin_idx").isNotNull())
    med = exact_percentiles(binned, value, {out: 0.5}, by="bin_idx", approx=approx, bounded_groups=True)
    return densify(med, bin_spine(spark, labels), "bin_idx")


def trim_trailing_empty(hist: DataFrame, n: str = "n", idx: str = "bin_idx") -> DataFrame:
    """Drop the empty bins after the last non-empty one (A43's distribution)."""
    last = hist.where(F.col(n) > 0).agg(F.max(idx)).scalar()
    return hist.where(F.col(idx) <= F.coalesce(last, F.lit(-1)))


def tail_share(hist: DataFrame, from_idx: int = 2, n: str = "n", pct: str = "pct") -> DataFrame:
    """Share and count of bins ``>= from_idx`` (A36, the ≥ $11 tail)."""
    t = F.col("bin_idx") >= F.lit(from_idx)
    return hist.agg(
        F.sum(F.when(t, F.col(pct)).otherwise(F.lit(0.0))).alias("tail_pct"),
        F.sum(F.when(t, F.col(n)).otherwise(F.lit(0))).alias("tail_n"),
    )


def equi_width_histogram(df: DataFrame, col: str, bins: int, n: str = "n") -> DataFrame:
    """``bins`` equal-width bins between min and max, max folded into the last.

    Min and max come from one scalar subquery; the row-side bin index is a
    projection, the counts a partial aggregate keyed by the bin (≤ ``bins`` rows).
    """
    spark = df.sparkSession
    v = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    st = scalars(v.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")), "lo", "hi")
    lo, hi = st["lo"], st["hi"]
    width = hi - lo
    raw = F.floor((F.col("_x") - lo) * F.lit(float(bins)) / width)
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    counts = v.select(idx.alias("bin_idx")).groupBy("bin_idx").agg(F.count(F.lit(1)).alias(n))
    spine = axis_frame(spark, "bin_idx", list(range(bins)))
    out = densify(counts, spine, "bin_idx", {n: 0})
    step = width / F.lit(float(bins))
    return out.select(
        "bin_idx",
        (lo + F.col("bin_idx") * step).alias("bin_lo"),
        (lo + (F.col("bin_idx") + 1) * step).alias("bin_hi"),
        n,
    )


def box_stats(df: DataFrame, col: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles (linear), IQR fences, whiskers and outlier count (A33), in two passes over the rows
    (:func:`ridelens.operators.common.box_row`)."""
    row = box_row(df, col, whisker)
    q1, q3 = F.col("q1"), F.col("q3")
    iqr = q3 - q1
    return row.select(
        "q1", "median", "q3", iqr.alias("iqr"), (q1 - F.lit(whisker) * iqr).alias("lower_fence"),
        (q3 + F.lit(whisker) * iqr).alias("upper_fence"), "whisker_low", "whisker_high", "n_outliers", "n",
    )
