"""Column rules for form text (X1-X11), all built-in expressions.

Every parser checks the text's shape with a pattern before casting, so a
value is either parsed exactly or NULL, never half-parsed: ``'12.0'`` is not
an integer, ``'NaN'`` / ``'1e3'`` are not numbers, a date is Y-M-D with a
four-digit year (one- or two-digit month and day, as Python's ``%Y-%m-%d``
accepts) and must exist on the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference application: form patterns (full match).
EMAIL_PATTERN = r"[^@\s]+@[^@\s]+\.[^@\s]+"
WEBSITE_PATTERN = r"https?://[^\s]+"
PHONE_PATTERN = r"[0-9+().\-\s]{7,20}"

INT_PATTERN = r"[+-]?[0-9]+"
DECIMAL_PATTERN = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?"
DATE_PATTERN = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
TIME_PATTERN = r"[0-9]{1,2}:[0-9]{1,2}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_match(c, pattern: str) -> Column:
    """Whole-text match; \\A..\\z so a trailing newline does not pass."""
    return _c(c).rlike(rf"\A(?:{pattern})\z")


# White space as str.strip() knows it.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def text(c) -> Column:
    """Form text as sent: a missing field counts as blank."""
    return F.coalesce(_c(c), F.lit(""))


def strip(c) -> Column:
    """Python ``str.strip()`` of a form text; a missing field gives ''."""
    return F.btrim(text(c), F.lit(SPACES))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normal_email(c) -> Column:
    return F.lower(strip(c))


def is_email(c) -> Column:
    return F.coalesce(full_match(c, EMAIL_PATTERN), F.lit(False))


def is_website_or_blank(c) -> Column:
    s = strip(c)
    return F.coalesce((s == "") | full_match(s, WEBSITE_PATTERN), F.lit(True))


def is_phone_or_blank(c) -> Column:
    s = strip(c)
    return F.coalesce((s == "") | full_match(s, PHONE_PATTERN), F.lit(True))


def parse_int(c) -> Column:
    s = strip(c)
    return F.when(full_match(s, INT_PATTERN), s.try_cast("int"))


def parse_long(c) -> Column:
    s = strip(c)
    return F.when(full_match(s, INT_PATTERN), s.try_cast("bigint"))


def parse_number(c) -> Column:
    """The number as written (up to 18 decimals), for range tests before any rounding."""
    s = strip(c)
    return F.when(full_match(s, DECIMAL_PATTERN), s.try_cast("decimal(38,18)"))


def parse_decimal(c, precision: int, scale: int) -> Column:
    """The number as the table stores it, rounded to ``scale``; NULL if it does not fit."""
    return parse_number(c).try_cast(f"decimal({precision},{scale})")


def parse_date(c) -> Column:
    s = strip(c)
    return F.when(full_match(s, DATE_PATTERN), F.try_to_date(s, "yyyy-M-d"))


def parse_time_of_day(c) -> Column:
    """'H:M' -> seconds of the day, NULL if not a real time of day."""
    s = strip(c)
    h = F.split(s, ":").getItem(0).try_cast("int")
    m = F.split(s, ":").getItem(1).try_cast("int")
    ok = full_match(s, TIME_PATTERN) & (h < 24) & (m < 60)
    return F.when(ok, h * 3600 + m * 60)


def longer_than(c, n: int) -> Column:
    return F.coalesce(F.length(_c(c)) > n, F.lit(False))


def reasons_of(rules: list[tuple[str, Column]]) -> Column:
    """Array of the texts whose condition is true, in rule order (no NULLs)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
                                     for text, cond in rules]))
