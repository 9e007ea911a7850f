"""Repeatable splits and folds.

Splits are functions of a stable row id, never of ``rand()`` or partition
layout, so a re-run (or a recomputed partition after an executor loss) assigns
every row to the same fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_hash(id_col: str, seed: int = 42) -> Column:
    """A seeded 32-bit hash of the id's text (text and numeric ids alike; standard MD5, so any engine agrees)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_fold(id_col: str, k: int, seed: int = 42) -> Column:
    """Fold in ``0..k-1`` from a hash of the id – shuffle-free, uniform in expectation."""
    return F.pmod(id_hash(id_col, seed), F.lit(k)).cast("int")


def train_test_split(df: DataFrame, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hash split on a stable id (M9): ``(train, test)``."""
    is_test = in_test(id_col, test_fraction, seed)
    return df.where(~is_test), df.where(is_test)


def in_test(id_col: str, test_fraction: float = 0.2, seed: int = 42) -> Column:
    """Whether a row belongs to the test side."""
    return F.pmod(id_hash(id_col, seed), F.lit(10000)) < F.lit(int(round(test_fraction * 10000)))


def kfold(df: DataFrame, id_col: str, k: int = 3, seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled k-fold assignment by id hash."""
    return df.withColumn(out, hash_fold(id_col, k, seed))


def fold_count(class_counts_min: int, k_max: int = 5) -> int:
    """``max(2, min(k_max, smallest class))``."""
    return max(2, min(k_max, int(class_counts_min)))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int | None = None,
                     k_max: int = 5, seed: int = 42, rows_per_range: int = 100_000, out: str = "fold") -> DataFrame:
    """Exactly balanced, shuffled stratified folds (M20), computed without a per-class task.

    Within each class, rows are ranked by a seeded hash of the id (any type) and
    dealt round robin: ``fold = rank mod k`` – every class is split into ``k``
    parts whose sizes differ by at most one. The rank is assembled from
      * the row number inside its ``(class, hash range)`` window – the number of
        ranges follows the largest class, so a range holds about
        ``rows_per_range`` rows whatever the skew, and
      * the rows of the class in the ranges before, from a running sum over the
        small ``(class, range)`` count table. Join and window share one shuffle.
    ``k`` defaults to ``max(2, min(k_max, smallest class size))``. Rows without a
    label form a class of their own.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    st = sizes.agg(F.struct(F.min("c").alias("lo"), F.max("c").alias("hi"))).scalar()
    ranges = F.ceil(st["hi"] / F.lit(float(rows_per_range)))
    kk = F.lit(int(k)) if k is not None else F.greatest(F.lit(2), F.least(F.lit(k_max), st["lo"])).cast("int")
    h = id_hash(id_col, seed)
    b = df.withColumn("_h", h).withColumn("_range", F.floor(h * ranges / F.lit(1 << 32)).cast("long"))
    counts = b.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col(label).alias("_l"), F.col("_range").alias("_r"),
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", F.col(id_col).cast("string")))
    ranked = b.join(offs, F.col(label).eqNullSafe(F.col("_l")) & F.col("_range").eqNullSafe(F.col("_r")))
    ranked = ranked.withColumn("_rank", F.col("_off") + local - F.lit(1))
    return ranked.withColumn(out, F.pmod(F.col("_rank"), kk).cast("int")).drop(
        "_h", "_range", "_l", "_r", "_off", "_rank")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced class weights ``n / (k * n_c)`` per class."""
    from ridelens.operators.common import scalars

    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    st = scalars(c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")), "total", "k")
    return c.withColumn(out, st["total"].cast("double") / (st["k"].cast("double") * F.col("n").cast("double")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight", bounded: bool = False) -> DataFrame:
    """Attach balanced weights to each row. The class table is small unless the label is
    no class at all; Spark broadcasts it by its measured size. ``bounded``: the caller has fitted an index of the
    labels, which holds all of them, so the table is broadcast and no row is shuffled by its class."""
    w = class_weights(df, label, out).select(label, out)
    return df.join(F.broadcast(w) if bounded else w, label, "left")
