"""Building blocks shared by all reports: counts, shares, densify, axis counts,
top-k, arg-max, exact percentiles, modes.

Scale notes
-----------
* Every aggregate is a plain ``groupBy().agg`` so Spark runs a partial (map-side)
  aggregate before the shuffle; a key holding a third of the rows costs one
  partial row per task, not a third of the data in one task.
* Totals for shares come from a *scalar subquery* over the already aggregated
  rows (``DataFrame.scalar()``): no join, no single-partition window, and the
  shuffle stage it needs is the same one as the main aggregate (AQE reuses it).
* Small fixed axes (a handful of bins) are one global aggregate with a counter
  per position (:func:`axis_counts`); larger axes join a spine of at most
  ``len(axis)`` rows with an aggregate keyed by that axis – both sides bounded
  by the axis length, which is what makes the broadcast safe.
* Exact percentiles never merge a whole group in one task: a sketch brackets
  each rank, and only the rows inside the bracket are ranked exactly
  (:func:`exact_percentiles`). Modes reduce to ``(key, value, count)`` and pick
  with ``min_by`` (partial, bounded).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions import pround


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------------------
# counts and shares
# ---------------------------------------------------------------------------
def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """One-row count of all rows (A1)."""
    return df.agg(F.count(F.lit(1)).alias(name))


# a table with this column holds rows counted before (see plans.cube): each stands for so many rows
ROWS = "_rows"


def weight_of(df: DataFrame) -> list[str]:
    """The column to keep beside the ones a report selects, if ``df`` holds counted rows."""
    return [ROWS] if ROWS in df.columns else []


def n_rows(df: DataFrame, when: Column | None = None) -> Column:
    """Aggregate: number of rows (for which ``when`` holds) that ``df`` stands for."""
    if ROWS not in df.columns:
        return F.count(F.lit(1)) if when is None else F.count_if(when)
    return F.coalesce(F.sum(ROWS if when is None else F.when(when, F.col(ROWS))), F.lit(0)).cast("long")


def value_counts(df: DataFrame, col: str, dropna: bool = False, name: str = "n") -> DataFrame:
    """Rows per value, count-descending then value-ascending (A2).

    ``dropna=False`` keeps NULL as its own group (``value_counts(dropna=False)``).
    """
    src = df.select(col, *weight_of(df))
    if dropna:
        src = src.where(F.col(col).isNotNull())
    return src.groupBy(col).agg(n_rows(src).alias(name))


# Fixed values of the frequent-items sketch behind approx_top_k: its map holds up to 3/4 of a power of two, its counts are
# off by at most 3.5 / map size of the rows, and it names every value above twice that
SKETCH_LOAD, SKETCH_ERROR = 0.75, 3.5


def top_values(df: DataFrame, col: str, k: int, name: str = "n", tracked: int = 20_000) -> DataFrame:
    """The ``k`` most frequent non-null values of a column with many distinct ones, exact, ties by value.

    A mergeable frequent-items sketch of bounded size names at most ``tracked`` candidates; a second pass counts those
    exactly (they are broadcast, so tasks send at most one row per candidate). The sketch's error bounds the
    frequency of every value it did not name; if the k-th exact count is above that bound, no other value can
    enter and the shuffle never grew with the number of values. Otherwise (evenly spread values) all values are counted.
    """
    src = df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull())
    total, items = src.agg(F.count(F.lit(1)), F.expr(f"transform(approx_top_k(_v, {tracked}, {tracked}), x -> x.item)")).first()
    kind = src.schema["_v"].dataType
    if items:
        known = df.sparkSession.createDataFrame([(x,) for x in items], T.StructType([T.StructField("_c", kind)]))
        counts = src.join(F.broadcast(known), F.col("_v") == F.col("_c")).groupBy(F.col("_v").alias(col)).agg(
            F.count(F.lit(1)).alias(name))
        top = order_by_count(counts, name, col).limit(k).collect()
        size = 2 ** math.ceil(math.log2(tracked / SKETCH_LOAD))
        if len(top) == k and top[-1][name] > 2 * SKETCH_ERROR / size * total:
            return df.sparkSession.createDataFrame(top, counts.schema)
    return order_by_count(value_counts(src.withColumnRenamed("_v", col), col, name=name), name, col).limit(k)


def order_by_count(df: DataFrame, n: str, key: str | Sequence[str]) -> DataFrame:
    """Count-descending with a deterministic key tie-break (O2)."""
    return df.orderBy(F.col(n).desc(), *[F.col(k).asc_nulls_last() for k in _cols(key)])


def top_k(df: DataFrame, by: str, k: int, key: str | Sequence[str], ascending: bool = False) -> DataFrame:
    """First ``k`` rows by ``by`` (ties → key ascending), via TakeOrderedAndProject (O3)."""
    first = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(first, *[F.col(c).asc_nulls_last() for c in _cols(key)]).limit(k)


def scalars(df: DataFrame, *cols: str) -> Column:
    """One scalar subquery returning a struct of ``cols`` of a one-row frame.

    Use its fields (``s["a"]``, ``s["b"]``) instead of one subquery per value:
    the same subquery referenced several times runs once (subquery reuse).
    """
    return df.select(F.struct(*cols)).scalar()


def total_of(df: DataFrame, n: str = "n") -> Column:
    """Scalar subquery ``SUM(n)`` over ``df`` – the share denominator."""
    return df.agg(F.sum(n)).scalar()


def with_share(
    df: DataFrame,
    n: str = "n",
    digits: int | None = 1,
    total: Column | None = None,
    out: str = "pct",
    floor_one: bool = False,
) -> DataFrame:
    """Add ``out = round_half_even(n / total * 100, digits)`` (A3).

    ``total`` defaults to the sum of ``n`` over ``df``; ``floor_one`` uses
    ``max(total, 1)`` like the booking-value table. Empty totals give NULL, not an
    error.
    """
    tot = total if total is not None else total_of(df, n)
    den = F.greatest(tot.cast("double"), F.lit(1.0)) if floor_one else tot.cast("double")
    raw = F.try_divide(F.col(n).cast("double"), den) * F.lit(100.0)
    return df.withColumn(out, pround(raw, digits) if digits is not None else raw)


# ---------------------------------------------------------------------------
# densify onto a fixed axis
# ---------------------------------------------------------------------------
def axis_frame(spark, key: str, values: Sequence, labels: Sequence[str] | None = None,
               label_col: str = "label", key_type: str = "int") -> DataFrame:
    """A spine with one row per axis value (and an optional label column).

    Built JVM-side (``inline`` of a literal array) so it plans as a tiny local
    relation, not a Python RDD.
    """
    return literal_rows(spark, [key] + ([label_col] if labels is not None else []),
                        [(v,) for v in values] if labels is None else list(zip(values, labels)),
                        [key_type] + (["string"] if labels is not None else []))


def literal_rows(spark, names: Sequence[str], rows: Sequence[Sequence], types: Sequence[str]) -> DataFrame:
    """A small fixed table as a JVM-side ``inline(array(struct(...)))``."""
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def axis_counts(df: DataFrame, idx: Column, labels: Sequence[str], n: str = "n",
                idx_name: str = "bin_idx", label_name: str = "label",
                extra: dict[str, Column] | None = None, trim_trailing: bool = False) -> DataFrame:
    """Rows per position of a small fixed axis, zeros kept, as ONE global aggregate.

    ``idx`` gives each row its axis position (0..len-1, NULL = none). The
    aggregate keeps one counter per position (plus ``extra`` aggregates such as
    a total), so every task emits a single partial row and nothing is shuffled by
    key; ``inline`` then turns the row into one row per position. Meant for
    axes of a handful of positions (bins, rating values). ``trim_trailing``
    drops the empty positions after the last non-empty one, read from the same
    row (no second pass).
    """
    src = df.select(idx.alias("_ix"))
    cells = [F.count(F.when(F.col("_ix") == F.lit(i), F.lit(1))).alias(f"_c{i}") for i in range(len(labels))]
    ex = extra or {}
    wide = src.agg(*cells, *[e.alias(k) for k, e in ex.items()])
    rows = F.array(*[
        F.struct(F.lit(i).alias(idx_name), F.lit(lbl).alias(label_name), F.col(f"_c{i}").alias(n))
        for i, lbl in enumerate(labels)
    ])
    if not trim_trailing:
        return wide.select(*ex.keys(), F.inline(rows))
    last = F.greatest(*[F.when(F.col(f"_c{i}") > 0, F.lit(i)) for i in range(len(labels))],
                      F.lit(-1)) if len(labels) > 0 else F.lit(-1)
    out = wide.select(*ex.keys(), last.alias("_last"), F.inline(rows))
    return out.where(F.col(idx_name) <= F.col("_last")).drop("_last")


def densify(agg: DataFrame, spine: DataFrame, key: str | Sequence[str],
            fill: dict | None = None) -> DataFrame:
    """Left-join a bounded aggregate onto its axis spine and fill the holes.

    ``agg`` must be keyed by the axis (at most ``len(spine)`` rows), which is what
    makes the broadcast safe at any data size.
    """
    keys = _cols(key)
    out = spine.join(F.broadcast(agg), keys, "left")
    if fill:
        out = out.fillna(fill)
    return out


# ---------------------------------------------------------------------------
# arg-max / top-N share
# ---------------------------------------------------------------------------
def arg_max(df: DataFrame, by: str | Sequence[str], tie: str | Sequence[str] | None = None,
            ascending_tie: bool = True) -> DataFrame:
    """The single row with the largest ``by`` (ties → smallest ``tie``)."""
    order = [F.col(b).desc() for b in _cols(by)]
    order += [(F.col(t).asc_nulls_last() if ascending_tie else F.col(t).desc()) for t in _cols(tie)]
    return df.orderBy(*order).limit(1)


def top_n_share(agg: DataFrame, n: str, k: int, key: str | Sequence[str], out: str = "share_pct") -> DataFrame:
    """One row: ``100 * sum(top-k n) / sum(n)``; 0 when empty."""
    top = top_k(agg, n, k, key)
    top_sum = top.agg(F.sum(n)).scalar()
    all_sum = agg.agg(F.sum(n)).scalar()
    spark = agg.sparkSession
    return spark.range(1).select(
        F.coalesce(F.try_divide(top_sum.cast("double") * F.lit(100.0), all_sum.cast("double")),
                   F.lit(0.0)).alias(out)
    )


# ---------------------------------------------------------------------------
# exact percentiles / median / mode, skew-safe
# ---------------------------------------------------------------------------
# sub-ranges a bracket is cut into before its values are ranked
RANK_RANGES = 1024


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float],
                      by: str | Sequence[str] | None = None, approx: bool = False,
                      accuracy: int = 10000, method: str = "bracket",
                      extra: dict | None = None, bounded_groups: bool = False,
                      carry: Sequence[str] = ()) -> DataFrame:
    """Exact (linearly interpolated) percentiles of ``value`` per ``by`` group, in two passes over the rows.

    ``method="bracket"`` (default) never merges a whole group in one task:
      1. one partial aggregate per group gives the row count, the ``extra``
         aggregates and, for every requested ``p``, a value bracket from
         ``percentile_approx`` at ``p ± 2/accuracy`` – constant memory per group
         (groups smaller than ``4·accuracy`` rows simply use their min/max);
      2. a second pass reduces the rows inside a bracket to ``(sub-range, value,
         frequency)`` and the rows below it to one counter. A bracket is cut into
         ``RANK_RANGES`` sub-ranges by value; a running sum over their counts
         finds the sub-range that holds the rank ``floor(p·(n−1))`` (and the next
         one), and only that sub-range's values are ranked: about
         ``4n/(accuracy·RANK_RANGES)`` distinct values in one task.
    A rank outside its bracket would contradict the sketch's error bound; the
    query then fails with a message instead of returning a wrong number.
    ``method="freq"`` reduces to ``(group, value, frequency)`` and merges every
    distinct value of a group in one task – fine for low-cardinality values.
    ``approx=True`` returns ``percentile_approx`` itself. NULL/NaN are ignored; a
    group that has nothing else is returned with NULL percentiles.
    ``accuracy="auto"`` sizes the sketch from the largest group (one extra count
    job, one number to the driver).
    ``bounded_groups=True`` (the caller knows the number of groups is small, e.g.
    bins, a list of columns, the zones of a counted dimension) broadcasts the
    one-row-per-group bracket to the rows, so the rows are never shuffled by
    group key; otherwise the join is left to Spark (AQE broadcast when small,
    skew join when a group is hot).
    ``extra`` maps output names to aggregate functions of the value column that
    ignore NULLs (e.g. ``{"n": F.count, "mean": F.avg}``); they are computed in
    the first pass and travel with the bracket; ``carry`` names further columns
    of ``df`` those functions may read with ``F.col``.
    """
    keys = _cols(by)
    if accuracy == "auto":
        accuracy = auto_accuracy(df, by)
    v = F.col(value).cast("double")
    src = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"), *carry)
    if not keys or method == "freq":
        src = src.where(F.col("_v").isNotNull())
    names = sorted(probs, key=lambda n: probs[n])
    ps = [float(probs[n]) for n in names]
    ex = [fn(F.col("_v")).alias(n) for n, fn in (extra or {}).items()]
    ex_names = list(extra or {})
    if approx:
        return src.groupBy(*keys).agg(
            *[F.percentile_approx("_v", float(p), accuracy).alias(n) for n, p in probs.items()], *ex)
    if method == "freq":
        if ex:
            raise ValueError("extra aggregates need method='bracket' or approx=True")
        freq = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_f"))
        return freq.groupBy(*keys).agg(
            *[F.percentile(F.col("_v"), F.lit(float(p)), F.col("_f")).alias(n) for n, p in probs.items()])

    stats = _brackets(src, keys, ps, accuracy, ex)
    side = F.broadcast(stats) if bounded_groups else stats
    if keys:
        rows = src.select(*keys, "_v").join(side, keys, "inner")
    else:  # one group: its bracket is a one-row scalar subquery, no join
        rows = src.select("_v", stats.select("_s").scalar().alias("_s"))
    win = _bracketed(rows, keys, len(ps))
    picks = _ranked_values(win, stats, keys, ps, bounded_groups or not keys)
    s = F.col("_s")
    if keys:
        per = _on(stats.dropna(subset=keys), F.broadcast(picks) if bounded_groups else picks, keys, "left")
    else:
        s = stats.select("_s").scalar()
        per = picks
    outside = F.raise_error(F.lit("a percentile's rank lies outside its bracket: raise accuracy")).cast("double")
    value = {n: F.when((s["_n"] > 0) & F.col(f"_p{names.index(n)}").isNull(), outside).otherwise(
        F.col(f"_p{names.index(n)}")).alias(n) for n in probs}
    return per.select(*keys, *value.values(), *[s[n].alias(n) for n in ex_names])


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal or both NULL ``keys``; null-safe equality adds no filters, so that readers share exchanges."""
    right = right.withColumnsRenamed({k: f"_h{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_h{k}"))
    return left.join(right, cond, how).drop(*[f"_h{k}" for k in keys])


# from this many ranks on, a bracket of 0.5 % on either side covers the sketch's error
MID_MARGIN = 0.005


def _brackets(src: DataFrame, keys: list[str], ps: list[float], accuracy: int, ex: list[Column]) -> DataFrame:
    """(keys, _s): per group the count, the extra aggregates and a value bracket per probability.

    The margin around a probability must cover the sketch's rank error (n / accuracy) and two ranks more: 2 / accuracy
    does for groups of 4·accuracy rows, ``MID_MARGIN`` for most smaller ones; the smallest take their min and max.
    """
    m = len(ps)
    margins = (2.0 / accuracy, MID_MARGIN)
    ends = [[f(p, e) for p in ps] for e in margins for f in (lambda p, e: max(0.0, p - e), lambda p, e: min(1.0, p + e))]
    stats = src.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        # one sketch answers all ends of every bracket
        F.percentile_approx("_v", F.array(*[F.lit(x) for x in sum(ends, [])]), accuracy).alias("_aq"), *ex)
    large = F.col("_n") >= F.lit(4 * accuracy)
    mid = F.lit(1.0 / accuracy) + F.lit(2.0) / F.greatest(F.col("_n"), F.lit(1)) <= F.lit(MID_MARGIN)

    def end(i: int, side: int, extreme: str) -> Column:
        limit = float(side)
        pick = [F.col(extreme) if ends[2 * k + side][i] == limit else F.col("_aq")[(2 * k + side) * m + i] for k in (0, 1)]
        return F.when(large, pick[0]).when(mid, pick[1]).otherwise(F.col(extreme))

    lo, hi = [end(i, 0, "_min") for i in range(m)], [end(i, 1, "_max") for i in range(m)]
    rest = [c for c in stats.columns if c not in (*keys, "_min", "_max", "_aq")]
    return stats.select(*keys, F.struct(*rest, F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi")).alias("_s"))


def _bracketed(rows: DataFrame, keys: list[str], m: int, more: Sequence[Column] = ()) -> DataFrame:
    """(keys, _i, _r, _v, _f): frequency of every value inside the bracket of probability ``_i``, with its sub-range.
    Rows below brackets collapse into counters with ``_i = -1``: as brackets rise with the probability, ``_r`` names
    the first one a row is below of. ``more``: further (i, r, v) tags, NULL for rows without; ``_low`` and ``_high``
    are then the extremes of the rows behind a tag."""
    lo, hi, v = F.col("_s._lo"), F.col("_s._hi"), F.col("_v")

    def spot(i: int) -> Column:
        at = F.floor((v - lo[i]) / (hi[i] - lo[i]) * F.lit(float(RANK_RANGES))).cast("int")
        at = F.when(hi[i] > lo[i], F.least(at, F.lit(RANK_RANGES - 1))).otherwise(F.lit(0))
        return F.struct(F.lit(i).alias("i"), at.alias("r"), v.alias("v"))

    below = F.lit(m - 1)
    for i in reversed(range(m - 1)):
        below = F.when(v < lo[i], F.lit(i)).otherwise(below)
    counter = F.struct(F.lit(-1).alias("i"), below.alias("r"), F.lit(None).cast("double").alias("v"))
    parts = [F.when(v < lo[m - 1], counter), *[F.when((v >= lo[i]) & (v <= hi[i]), spot(i)) for i in range(m)], *more]
    tagged = rows.select(*keys, v.alias("_x"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("_t"))
    extremes = [F.min("_x").alias("_low"), F.max("_x").alias("_high")] if more else []
    return tagged.groupBy(*keys, F.col("_t.i").alias("_i"), F.col("_t.r").alias("_r"),
                          F.col("_t.v").alias("_v")).agg(F.count(F.lit(1)).alias("_f"), *extremes)


def _ranked_values(win: DataFrame, stats: DataFrame, keys: list[str], ps: list[float], bounded: bool) -> DataFrame:
    """(keys, _p0, _p1, ...): the interpolated value of every probability; without keys always one row."""
    m = len(ps)
    # a counter counts for its own and for all higher brackets, as a sub-range before the first
    later = F.transform(F.sequence("_r", F.lit(m - 1)), lambda i: F.struct(i.alias("i"), F.lit(-1).alias("r")))
    cells = F.when(F.col("_i") >= 0, F.array(F.struct(F.col("_i").alias("i"), F.col("_r").alias("r")))).otherwise(later)
    flat = win.select(*keys, "_f", F.explode(cells).alias("_c")).groupBy(
        *keys, F.col("_c.i").alias("_i"), F.col("_c.r").alias("_r")).agg(F.sum("_f").alias("_f"))
    # at most RANK_RANGES + 1 rows per group and probability
    before = Window.partitionBy(*keys, "_i").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("_before", F.coalesce(F.sum("_f").over(before), F.lit(0)))
    if keys:
        n = stats.select(*keys, F.col("_s._n").alias("_n"))
        flat = _on(flat, F.broadcast(n) if bounded else n, keys)
    else:
        flat = flat.withColumn("_n", stats.select("_s").scalar()["_n"])
    pos = F.array(*[F.lit(p) for p in ps])[F.col("_i")] * (F.col("_n") - 1).cast("double")
    k0 = F.floor(pos)
    k1 = F.least(k0 + 1, F.col("_n") - 1)
    holds = [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_f")) for k in (k0, k1)]
    # at most two sub-ranges per group and probability; _r < 0 holds no value, so the rank stays without one
    hit = flat.where(holds[0] | holds[1]).select(*keys, "_i", "_r", "_before", pos.alias("_pos"), k0.alias("_k0"),
                                                 k1.alias("_k1"))
    ranked = _on(win.where("_i >= 0"), F.broadcast(hit) if bounded else hit, [*keys, "_i", "_r"])
    order = Window.partitionBy(*keys, "_i", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_cum", F.sum("_f").over(order) + F.col("_before"))
    picks = []
    for i in range(m):
        at, own = F.col("_i") == i, []
        for k in ("_k0", "_k1"):
            # of the sub-range that holds the rank: values before it have too small a running count
            here = at & (F.col("_cum") > F.col(k)) & (F.col("_before") <= F.col(k))
            own.append(F.min(F.when(here, F.col("_v"))))
        share = F.max(F.when(at, F.col("_pos") - F.floor("_pos")))
        picks.append((own[0] + share * (own[1] - own[0])).alias(f"_p{i}"))
    return ranked.groupBy(*keys).agg(*picks)


def box_row(df: DataFrame, value: str, whisker: float, accuracy: int = 10000) -> DataFrame:
    """One row: q1, median, q3, whisker_low, whisker_high, n_outliers, n – exact, in two passes over the rows.

    The brackets of the quartiles bound each fence, too. The second pass keeps the frequencies of the values between a
    fence's bounds; the rows that are surely within both fences, or surely outside, are a counter with their extremes.
    """
    v = F.col(value).cast("double")
    src = df.select(F.when(~F.isnan(v), v).alias("_v")).where(F.col("_v").isNotNull())
    ps = [0.25, 0.5, 0.75]
    stats = _brackets(src, [], ps, accuracy, [])
    s = stats.select("_s").scalar()
    rows = src.select("_v", s.alias("_s"))
    lo, hi, x = F.col("_s._lo"), F.col("_s._hi"), F.col("_v")
    wide, narrow = (hi[2] - lo[0]) * F.lit(whisker), (lo[2] - hi[0]) * F.lit(whisker)
    unsure = x.between(lo[0] - wide, hi[0] - narrow) | x.between(lo[2] + narrow, hi[2] + wide)
    out = (x < lo[0] - wide) | (x > hi[2] + wide)
    tag = F.when(unsure, -2).when(out, -4).otherwise(-3)
    more = F.struct(tag.alias("i"), F.lit(0).alias("r"), F.when(unsure, x).alias("v"))
    win = _bracketed(rows, [], len(ps), [more])
    q = _ranked_values(win.where("_i >= -1"), stats, [], ps, True)
    q = q.select(F.struct(*[F.col(f"_p{i}") for i in range(3)]).alias("q")).scalar()
    fences = [q["_p0"] - F.lit(whisker) * (q["_p2"] - q["_p0"]), q["_p2"] + F.lit(whisker) * (q["_p2"] - q["_p0"])]
    inside = (F.col("_i") == -3) | ((F.col("_i") == -2) & (F.col("_v") >= fences[0]) & (F.col("_v") <= fences[1]))
    rest = win.where("_i <= -2").agg(
        F.min(F.when(inside, F.col("_low"))).alias("whisker_low"), F.max(F.when(inside, F.col("_high"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_f"))), F.lit(0)).cast("long").alias("n_outliers"),
        F.coalesce(F.sum("_f"), F.lit(0)).cast("long").alias("n"))
    return rest.select(q["_p0"].alias("q1"), q["_p1"].alias("median"), q["_p2"].alias("q3"), "*")


def auto_accuracy(df: DataFrame, by=None, window_rows: int = 1_000_000) -> int:
    """Sketch accuracy that keeps ``4n/accuracy`` ≤ ``window_rows`` for the
    largest group (clamped to 10⁴ … 10⁷)."""
    keys = _cols(by)
    biggest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return int(min(10_000_000, max(10_000, math.ceil(4 * biggest / window_rows))))


def mode_of(df: DataFrame, value: str, by: str | Sequence[str] | None = None,
            out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; ties → smallest value.

    Same two-level reduction as :func:`exact_percentiles`.
    """
    keys = _cols(by)
    src = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    freq = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_f"))
    # max_by over (frequency, -rank of value): emulate "smallest value on ties" by
    # taking min_by over (-frequency, value).
    best = F.min_by(F.col("_v"), F.struct((-F.col("_f")).alias("nf"), F.col("_v").alias("v")))
    return freq.groupBy(*keys).agg(best.alias(out))


def group_summary(df: DataFrame, keys: str | Sequence[str], aggs: dict[str, tuple[str, str]],
                  dropna: bool = False) -> DataFrame:
    """Named aggregates per group (A4): ``aggs`` maps output → (column, function)
    with functions ``count`` (non-null), ``size`` (rows), ``mean``, ``sum``,
    ``min``, ``max``, ``nunique``, ``std``. ``dropna`` drops NULL keys like
    pandas' default ``groupby``."""
    fns = {
        "count": lambda c: F.count(F.col(c)),
        "size": lambda c: F.count(F.lit(1)),
        "mean": lambda c: F.avg(F.col(c)),
        "sum": lambda c: F.sum(F.col(c)),
        "min": lambda c: F.min(F.col(c)),
        "max": lambda c: F.max(F.col(c)),
        "nunique": lambda c: F.count_distinct(F.col(c)),
        "std": lambda c: F.stddev_samp(F.col(c)),
    }
    ks = _cols(keys)
    src = df
    if dropna:
        for k in ks:
            src = src.where(F.col(k).isNotNull())
    return src.groupBy(*ks).agg(*[fns[f](c).alias(name) for name, (c, f) in aggs.items()])


def kpis(df: DataFrame, col: str, digits: int | None = 4) -> DataFrame:
    """Rows, non-null, sum, mean, min, max and the max − min span of a column."""
    x = F.col(col).cast("double")
    r = (lambda c: pround(c, digits)) if digits is not None else (lambda c: c)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(x).alias("n_valid"),
        r(F.sum(x)).alias("total"),
        r(F.avg(x)).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        r(F.max(x) - F.min(x)).alias("span"),
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows for a quick look (O5) – a ``limit``, nothing else."""
    return df.limit(n)


def modes(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Most frequent non-null value (as text) of several columns in one pass,
    smallest value on ties, ``defaults[col]`` when a column has none (A34).

    The columns are stacked into ``(column, value)`` so one partial aggregate
    counts all of them; the per-column pick is a ``min_by`` (partial, bounded).
    Ties go to the smallest value of the column's own type: a numeric column
    carries its number as the sort key (2 before 10), text sorts as text.
    """
    cols = list(defaults)

    def key(c: str) -> Column:
        numeric_type = isinstance(df.schema[c].dataType, T.NumericType)
        return F.col(c).cast("double") if numeric_type else F.lit(None).cast("double")

    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v"), key(c).alias("_k")) for c in cols
    ]))).where(F.col("_v").isNotNull())
    freq = long.groupBy("_c", "_v", "_k").agg(F.count(F.lit(1)).alias("_f"))
    best = F.min_by(F.col("_v"), F.struct((-F.col("_f")).alias("nf"), F.col("_k").alias("k"), F.col("_v").alias("v")))
    per = freq.groupBy("_c").agg(best.alias("_m"))
    row = per.agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(c) for c in cols])
    return row.select(*[F.coalesce(F.col(c), F.lit(str(d))).alias(c) for c, d in defaults.items()])
