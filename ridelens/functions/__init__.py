"""Column builders – pure ``Column`` expressions, no jobs, no UDFs."""

from ridelens.functions.dates import (  # noqa: F401
    MONTH_NAMES,
    NIGHT_HOURS,
    PEAK_HOURS,
    WEEKDAY_ABBR,
    WEEKDAY_NAMES,
    date_parts,
    hour_of_time_text,
    month_name,
    month_to_num,
    parse_hour,
    parse_weekday,
    weekday_name,
)
from ridelens.functions.numeric import (  # noqa: F401
    as_flag,
    between,
    bin_index,
    bin_label,
    clip,
    numeric,
    pround,
    to_int,
    to_long,
    to_number,
)
from ridelens.functions.text import (  # noqa: F401
    EMAIL_PATTERN,
    contains_ci,
    eq_ci,
    fmt_currency,
    fmt_pct,
    fmt_thousands,
    is_blank,
    min_sec,
    number_text,
    stars,
    strip_ws,
    with_unit,
)
