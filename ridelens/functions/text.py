"""Text predicates and formatting builders (F7, F8, F9 pieces, P14, X11, X13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.functions._util import col_of
from ridelens.functions.numeric import pround

# Fixed value: the feedback form's e-mail pattern.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def contains_ci(c, text: str) -> Column:
    """Case-insensitive substring test; NULL → false (``str.contains(case=False, na=False)``)."""
    return F.coalesce(F.lower(col_of(c)).contains(text.lower()), F.lit(False))


def eq_ci(a, b) -> Column:
    """Case-insensitive equality of two string columns / literals."""
    bb = F.lit(b) if isinstance(b, str) and not isinstance(b, Column) else col_of(b)
    return F.lower(col_of(a)) == F.lower(bb)


def is_blank(c) -> Column:
    """NULL or only whitespace."""
    return F.coalesce(F.length(strip_ws(c)) == 0, F.lit(True))


def number_text(c) -> Column:
    """Shortest text of a double as Python's ``str(float)`` prints it for small values
    (``12.0``, ``12.35``) – Spark's cast gives the same digits."""
    return col_of(c).cast("double").cast("string")


def with_unit(c, digits: int, unit: str) -> Column:
    """``"12.35 km"`` – half-even rounded value followed by a unit."""
    return F.concat(number_text(pround(c, digits)), F.lit(unit))


def min_sec(c) -> dict[str, Column]:
    """Minutes → whole minutes, seconds and a label (X11).

    The label is ``"X min YY sec"``, or ``"S sec"`` under one minute. Negative
    values count as 0; NULL stays NULL.
    """
    x = col_of(c).cast("double")
    total = F.greatest(F.lit(0.0), F.rint(x * F.lit(60.0))).cast("long")
    mins = F.floor(total / F.lit(60)).cast("long")
    secs = (total % F.lit(60)).cast("long")
    label = F.when(mins > 0, F.format_string("%d min %02d sec", mins, secs)).otherwise(
        F.format_string("%d sec", secs)
    )
    return {
        "minutes": F.when(x.isNotNull(), mins),
        "seconds": F.when(x.isNotNull(), secs),
        "label": F.when(x.isNotNull(), label),
    }


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(col_of(c), r"\A\s+|\s+\z", "")


def fmt_thousands(c, digits: int = 0) -> Column:
    """``12,345`` / ``12,345.68`` – thousands separators."""
    return F.format_number(col_of(c).cast("double"), digits)


def fmt_currency(c, symbol: str = "$", digits: int = 2) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit(symbol), F.format_number(col_of(c).cast("double"), digits))


def fmt_pct(c, digits: int = 1) -> Column:
    """``61.9%`` from a percentage value, half-even rounded."""
    return F.concat(F.format_string(f"%.{digits}f", pround(col_of(c), digits)), F.lit("%"))


def stars(c, symbol: str = "★") -> Column:
    """A rating as a row of stars, rounded half-even, clamped 0–5."""
    n = F.greatest(F.lit(0), F.least(F.lit(5), pround(col_of(c), 0).cast("int")))
    return F.when(col_of(c).isNotNull(), F.repeat(F.lit(symbol), n))
