"""Numeric column builders: rounding, coercion, clipping, right-closed bins.

Every builder returns a ``Column`` so it stays inside whole-stage codegen; none
of them triggers a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.functions._util import col_of


def pround(c, digits: int = 0) -> Column:
    """Half-even rounding to ``digits`` places (numpy/pandas ``.round``).

    ``F.round`` is half-up and ``F.bround`` rounds the decimal text, neither of
    which matches binary-float half-even; ``rint`` on the scaled value does.
    """
    scale = float(10**digits)
    return F.rint(col_of(c) * F.lit(scale)) / F.lit(scale)


def to_long(c, digits: int = 0) -> Column:
    """Round half-even then convert to a 64-bit integer (``int(round(x))``)."""
    return pround(c, digits).cast("long")


def to_number(c) -> Column:
    """Lenient numeric coercion: bad text → NULL, NaN → NULL (``errors="coerce"``)."""
    return F.nanvl(col_of(c).try_cast("double"), F.lit(None).cast("double"))


def to_int(c) -> Column:
    """Lenient whole number: bad text, NaN, infinity and out-of-range values → NULL; fractions are cut off."""
    return col_of(c).try_cast("double").try_cast("int")


def numeric(df, c: str) -> Column:
    """Column ``c`` of ``df`` as a number.

    A numeric column passes through untouched, so predicates on it still reach
    the Parquet scan (NaN has already become NULL at ingest); only text columns
    take the lenient :func:`to_number` path.
    """
    from pyspark.sql.types import NumericType

    if isinstance(df.schema[c].dataType, NumericType):
        return F.col(c)
    return to_number(c)


def clip(c, lo=None, hi=None) -> Column:
    """Clamp into ``[lo, hi]``; NULL stays NULL (``Series.clip``)."""
    x = col_of(c)
    out = x
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return F.when(x.isNotNull(), out)


def bin_index(c, edges: Sequence[float]) -> Column:
    """Right-closed bin index on ``edges`` (``pd.cut(right=True, include_lowest=True)``).

    Bin ``i`` is ``(edges[i], edges[i+1]]``; the first bin also takes ``edges[0]``.
    Values below the first edge, above the last, NaN or NULL get NULL.
    ``Bucketizer``/``width_bucket`` are left-closed, so they are not used.
    """
    x = col_of(c)
    inf = float("inf")
    expr = None
    for i in range(len(edges) - 1):
        hi = edges[i + 1]
        cond = x <= F.lit(hi) if hi != inf else x < F.lit(inf)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    guard = (x >= F.lit(edges[0])) & ~F.isnan(x)
    return F.when(guard, expr)


def bin_label(idx, labels: Sequence[str]) -> Column:
    """Label for a bin index produced by :func:`bin_index` (NULL stays NULL)."""
    arr = F.array(*[F.lit(s) for s in labels])
    i = col_of(idx)
    return F.when(i.isNotNull(), F.element_at(arr, i + F.lit(1)))


def between(c, lo, hi) -> Column:
    """Closed range test with NULL → false (pandas comparison semantics)."""
    return F.coalesce(col_of(c).between(lo, hi), F.lit(False))


def as_flag(pred: Column) -> Column:
    """Predicate → 1.0/0.0 with NULL counted as 0 (pandas ``mask.mean()``)."""
    return F.when(pred, F.lit(1.0)).otherwise(F.lit(0.0))
