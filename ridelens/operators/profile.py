"""Table profiling: shape, column profile, missing values, duplicates, describe,
correlation (A26–A31).

Most profiles are one aggregate over the table (partial aggregation per task)
followed by an ``explode`` of a literal array of structs to turn the one wide
row into one row per column. Exact distinct counts take an aggregate per column, each over that column alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions import pround
from ridelens.operators.common import exact_percentiles


def _long(wide: DataFrame, items: list[tuple], names: Sequence[str]) -> DataFrame:
    """Turn a one-row frame into rows: ``items`` = list of tuples of Columns."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(it, names)]) for it in items]
    return wide.select(F.inline(F.array(*structs)))


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """(name, Spark type) pairs – schema only, no job."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


# a bitmap of Spark's covers this many integers
BITMAP_VALUES = 32_768


def distinct_counts(df: DataFrame) -> DataFrame:
    """(position, n_unique): exact distinct non-null values of every column, rows unexpanded (A10).

    Each column has an aggregate of its own that scans this column alone, with a partial set of its values per task; a
    columnar table is read once in all. Integers that lie densely (judged by one first aggregate of min, max and count)
    are counted by bitmaps: a task sends 4 KB per 32,768 neighbouring integers instead of the integers. ``df`` should be
    a stored table; the work behind a view is repeated per column.
    """
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    dense: dict[str, int] = {}
    if whole:
        row = df.agg(*[fn(F.col(f"`{c}`").cast("long")).alias(f"{n}{i}") for i, c in enumerate(whole)
                       for n, fn in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
        for i, c in enumerate(whole):
            lo, hi, n = row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"]
            # a bitmap takes as much as some 256 single values
            if n and (hi - lo) // BITMAP_VALUES <= 16 + n // 256:
                dense[c] = lo
    parts = []
    for i, c in enumerate(df.columns):
        one = df.select(F.col(f"`{c}`").alias("v")).where(F.col("v").isNotNull())
        if c in dense:
            v = F.col("v").cast("long") - F.lit(dense[c])
            bits = one.groupBy(F.bitmap_bucket_number(v).alias("b")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("m"))
            n = bits.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).cast("long").alias("n_unique"))
        else:
            n = one.distinct().agg(F.count(F.lit(1)).alias("n_unique"))
        parts.append(n.select(F.lit(i + 1).alias("position"), "n_unique"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: position, type, non-null count, total rows, distinct non-null values.

    ``approx=True`` uses HyperLogLog (``approx_count_distinct``) instead of :func:`distinct_counts`: constant memory and
    one scan.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"_nn{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_u{i}"))
    wide = df.agg(*aggs)
    names = ["position", "column_name", "dtype", "non_null", "total"]
    items = [(F.lit(i + 1), F.lit(c), F.lit(t), F.col(f"_nn{i}"), F.col("_total"), *([F.col(f"_u{i}")] if approx else []))
             for i, (c, t) in enumerate(column_types(df))]
    if approx:
        return _long(wide, items, [*names, "n_unique"])
    # one row per column on both sides
    return _long(wide, items, names).join(F.broadcast(distinct_counts(df)), "position").select(*names, "n_unique")


def missing_report(df: DataFrame, digits: int = 4) -> DataFrame:
    """Per column: missing count and missing %."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    items = []
    for i, c in enumerate(cols):
        miss = F.col("_total") - F.col(f"_nn{i}")
        pct = pround(F.try_divide(miss.cast("double"), F.col("_total").cast("double")) * F.lit(100.0), digits)
        items.append((F.lit(c), miss, pct))
    return _long(wide, items, ["column_name", "missing_n", "missing_pct"])


def _row_digest(cols: Sequence[str]) -> list:
    """Two 64-bit hashes of a row and a third one that tells colliding rows apart. Which columns are NULL is hashed
    too, as Spark's hash passes over them."""
    quoted = [F.col(f"`{c}`") for c in cols]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in quoted])
    return [F.xxhash64(F.lit(k), nulls, *quoted).alias(n) for k, n in enumerate(("_h1", "_h2", "_h3"))]


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row (all columns equal, NULLs equal).

    Rows are counted by a 128-bit digest, so the shuffle (digest, count and the extremes of a third hash) does not depend on
    the width of the rows. Where rows of one digest differ in the third hash, and only there, the rows
    themselves are compared; without collisions that branch is empty and AQE drops it. Map columns are no keys, as in
    any grouping.
    """
    cols = list(subset or df.columns)
    rows = df.select(*[F.col(f"`{c}`") for c in cols], *_row_digest(cols))
    g = rows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min("_h3").alias("_lo"), F.max("_h3").alias("_hi"))
    plain = g.where("_lo = _hi").select(F.col("_n") - 1)
    mixed = g.where("_lo <> _hi").select(F.col("_h1").alias("_c1"), F.col("_h2").alias("_c2"))
    exact = rows.join(mixed, (F.col("_h1") == F.col("_c1")) & (F.col("_h2") == F.col("_c2")), "left_semi")
    exact = exact.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n")).select(F.col("_n") - 1)
    return plain.union(exact).toDF("_d").agg(F.coalesce(F.sum("_d"), F.lit(0)).cast("long").alias("n_duplicates"))


def describe(df: DataFrame, cols: Sequence[str], digits: int = 4, approx: bool = False) -> DataFrame:
    """count, mean, std (n−1), min, 25/50/75 % (linear, exact), max per column.

    The columns are stacked into ``(column_name, value)`` once so all columns share
    one pre-aggregation pass and one percentile merge keyed by column.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols
    ])))
    q = exact_percentiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by="column_name",
                          approx=approx, bounded_groups=True, extra={"count": F.count, "mean": F.avg, "std": F.stddev_samp,
                                                "min": F.min, "max": F.max})
    return q.select("column_name", "count", pround("mean", digits).alias("mean"), pround("std", digits).alias("std"),
                    "min", *[pround(c, digits).alias(c) for c in ("q25", "q50", "q75")], "max")


def correlation(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation matrix, every ordered pair and the diagonal, pairwise-complete rows.

    ``F.corr`` skips a row only for the pair where one side is NULL, which is the
    pandas behaviour (``ml.stat.Correlation`` would reject NULLs). Each unordered
    pair is computed once; a constant column has no correlation (NULL).
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.nanvl(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(None)).alias(f"_c{i}")
                    for i, (a, b) in enumerate(pairs)])
    items = [(F.lit(x), F.lit(y), pround(F.col(f"_c{i}"), digits))
             for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return _long(wide, items, ["col_a", "col_b", "corr"])
