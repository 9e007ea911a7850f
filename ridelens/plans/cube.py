"""Counted rows behind the persisted count, share, heat-map and zone reports.

One GROUPING SETS aggregate over a table gives, per set of key columns that some reports group by, the number of rows and,
where fares are summed, their sum and number. It is written once, a folder per set; the reports then read a few thousand
counted rows instead of the fact rows. The same report functions run on both: a table with a ``_rows`` column stands for
that many rows (:func:`ridelens.operators.common.n_rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import numeric
from ridelens.operators.common import ROWS

# slice → key columns; small domains only (a slice has at most one row per combination)
CLEAN_SLICES = {
    "time": ["hour", "weekday", "month"],
    "status": ["booking_status"],
    "payment": ["payment_method"],
    "customer_reason": ["reason_for_cancelling_by_customer"],
    "driver_reason": ["driver_cancellation_reason"],
}
REGION_SLICES = {
    "time": ["hour", "weekday"],
    "pickup": ["pickup_location", "hour"],
    "drop": ["drop_location"],
}


def counted(df: DataFrame, slices: dict[str, list[str]], fares: bool = False) -> DataFrame:
    """(slice, keys, _rows [, _revenue, _fares]): all slices in one pass over ``df``.

    ``fares``: sum and number of the positive booking values.
    """
    keys = list(dict.fromkeys(c for cols in slices.values() for c in cols))
    rows = df.select(*keys, *([numeric(df, "booking_value").cast("double").alias("fare")] if fares else []))
    aggs = [F.count(F.lit(1)).alias(ROWS), F.grouping_id(*keys).cast("long").alias("gid")]
    if fares:
        paid = F.when(F.col("fare") > 0, F.col("fare"))
        aggs += [F.coalesce(F.sum(paid), F.lit(0.0)).alias("_revenue"), F.count(paid).alias("_fares")]
    cells = rows.groupingSets([list(cols) for cols in slices.values()], *keys).agg(*aggs)
    # grouping_id has a bit per key, the first one highest, set where the key is not of the set
    name = F.lit(None).cast("string")
    for s, cols in slices.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in cols)
        name = F.when(F.col("gid") == gid, F.lit(s)).otherwise(name)
    return cells.withColumn("slice", name).drop("gid")


def slice_of(cells: DataFrame, slices: dict[str, list[str]], name: str) -> DataFrame:
    """The counted rows of one slice: its keys, ``_rows`` and the sums."""
    sums = [c for c in ("_revenue", "_fares") if c in cells.columns]
    return cells.where(F.col("slice") == name).select(*slices[name], ROWS, *sums)
