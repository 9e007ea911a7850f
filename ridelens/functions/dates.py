"""Date / hour / weekday / month column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.functions._util import col_of
from ridelens.functions.numeric import to_int

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (English calendar names and the
# name → number tables of the scorer and the heat-map normaliser).
# ---------------------------------------------------------------------------
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
# Peak hours 7–11 and 16–20, night hours 0–5 (demand KPIs).
PEAK_HOURS = [7, 8, 9, 10, 11, 16, 17, 18, 19, 20]
NIGHT_HOURS = [0, 1, 2, 3, 4, 5]


def _name_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def _weekday_lookup() -> dict[str, int]:
    out = {}
    for i, (full, abbr) in enumerate(zip(WEEKDAY_NAMES, WEEKDAY_ABBR)):
        out[full.lower()] = i
        out[abbr.lower()] = i
    return out


def weekday_name(idx, abbreviated: bool = False) -> Column:
    """0=Monday … 6=Sunday → English name; out of range → NULL."""
    names = WEEKDAY_ABBR if abbreviated else WEEKDAY_NAMES
    i = col_of(idx)
    return F.when(i.between(0, 6), F.element_at(F.array(*[F.lit(n) for n in names]), i + F.lit(1)))


def month_name(idx) -> Column:
    """1–12 → English month name; out of range → NULL."""
    i = col_of(idx)
    return F.when(i.between(1, 12), F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), i))


def month_to_num(c) -> Column:
    """Month name (trimmed, any case) → 1–12; unknown → NULL."""
    table = {n.lower(): i + 1 for i, n in enumerate(MONTH_NAMES)}
    return F.element_at(_name_map(table), F.lower(F.trim(col_of(c).cast("string")))).cast("int")


def parse_weekday(c, unknown=None) -> Column:
    """Weekday from a number or an English name (full or 3-letter, trimmed, any case).

    Numbers pass through unchanged (rebasing 1–7 is :func:`normalize_weekday`'s job);
    an unrecognised value gives ``unknown`` (NULL by default, 0 for the scorer).
    """
    text = F.lower(F.trim(col_of(c).cast("string")))
    num = to_int(text)
    named = F.element_at(_name_map(_weekday_lookup()), text).cast("int")
    out = F.coalesce(num, named)
    if unknown is not None:
        out = F.coalesce(out, F.lit(int(unknown)))
    return out


def parse_hour(c) -> Column:
    """Hour from text: a number, ``HH:mm``, ``HH:mm:ss`` or a 12-hour clock (``7 pm``, ``7pm``, ``7:30 PM``, ``7:30PM``).

    Row-wise superset of the reference, which tries the text formats only when no
    row of the column is numeric; this avoids a global pass. Anything else
    (``nan``, infinities, numbers that are no int) is NULL.
    """
    raw = F.trim(col_of(c).cast("string"))
    up = F.regexp_replace(F.upper(raw), r"\s+(?=[AP]M$)", "")
    clock = [F.hour(F.try_to_timestamp(raw, F.lit(f))) for f in ("H:mm", "H:mm:ss")]
    half = [F.hour(F.try_to_timestamp(up, F.lit(f))) for f in ("ha", "h:mma")]
    return F.coalesce(to_int(raw), *clock, *half)


def hour_of_time_text(c, fmt: str = "HH:mm:ss", strict: bool = False) -> Column:
    """``HH:mm:ss`` text → hour (0–23).

    Unparseable text gives NULL, or – with ``strict=True`` – fails the query like
    the reference's parser (``to_timestamp`` raises under ANSI mode)."""
    x = col_of(c).cast("string")
    if strict:
        return F.hour(F.to_timestamp(x, fmt))
    return F.hour(F.try_to_timestamp(x, F.lit(fmt)))


def date_parts(c, fmt: str = "yyyy-MM-dd") -> dict[str, Column]:
    """Month, day and weekday (0=Monday) of a date or date text."""
    x = col_of(c)
    d = F.coalesce(F.try_to_date(x.cast("string"), fmt), x.try_cast("date"))
    return {
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "weekday": F.weekday(d),
    }
