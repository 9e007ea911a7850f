"""Rows of conversations in order, with very long conversations cut into parts.

The order within a conversation is (turn, key), null turns first; the key is a digest of role and text, so rows of one
turn have a fixed order and only equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import materialize

LONG_ROWS = 20_000
LONG_BYTES = 32_000_000
MAX_PARTS = 1_000


def row_key(role: Column, text: Column) -> Column:
    """A 128-bit digest of role and text, as 32 hex digits."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def with_parts(rows: DataFrame, size: Column | None = None, long_rows: int = LONG_ROWS,
               long_bytes: int = LONG_BYTES) -> tuple[DataFrame, bool]:
    """``rows`` (conv, turn, key, ...) with ``part``: null in a conversation of few rows and bytes, else a number; and
    whether there is any long conversation.

    A long conversation is cut at rows that a hash of (turn, key) chooses, about every ``long_rows`` rows (or
    ``long_bytes``), at ``MAX_PARTS`` places at most on average; parts follow each other in the order of the rows. Equal rows
    are in one part. The break points (a row per long conversation) are joined to the rows; there are few of them, and
    Spark broadcasts them only if their table is small.
    """
    bytes_ = F.coalesce(F.sum(size) if size is not None else F.lit(0), F.lit(0))
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), bytes_.alias("bytes"))
    parts = F.greatest(F.col("n") / long_rows, F.col("bytes") / long_bytes)
    long = sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(
        F.col("conv").alias("c"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.least(parts, F.lit(
            MAX_PARTS)))).cast("long").alias("every"))
    long = materialize(long, "conv-long")
    if long.isEmpty():
        return rows.withColumn("part", F.lit(None).cast("int")), False
    chosen = rows.select("conv", "turn", "key").join(long, F.col("conv").eqNullSafe(F.col("c"))).where(
        F.pmod(F.xxhash64("turn", "key"), F.col("every")) == 0)
    breaks = chosen.groupBy("c").agg(F.sort_array(F.collect_set(F.struct("turn", "key"))).alias("breaks"))
    breaks = long.join(breaks.withColumnRenamed("c", "b"), F.col("c").eqNullSafe(F.col("b")), "left")
    breaks = materialize(breaks.select("c", F.coalesce("breaks", F.array().cast(
        "array<struct<turn:bigint,key:string>>")).alias("breaks")), "conv-breaks")
    here = F.struct("turn", "key")
    part = F.when(F.col("breaks").isNotNull(), F.size(F.filter("breaks", lambda b: b <= here)))
    return rows.join(breaks, F.col("conv").eqNullSafe(F.col("c")), "left").select(
        *rows.columns, part.cast("int").alias("part")), True
