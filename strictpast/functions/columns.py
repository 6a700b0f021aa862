"""Column -> Column helpers. Doubles carry NULL for "missing", never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Market identifier codes and the exchange names the rules use.
MIC_TO_EXCHANGE = {"XNYS": "NYSE", "XASE": "AMEX", "XNAS": "NASDAQ"}

# Security types kept as they are; everything else is OTHER.
KNOWN_TYPES = (
    "CS",
    "PFD",
    "ETF",
    "ETN",
    "ADRC",
    "ADRP",
    "UNIT",
    "WARRANT",
    "RIGHT",
    "FUND",
    "SP",
)
OTHER_TYPE = "OTHER"
COMMON_STOCK = "CS"

# The statement period kinds that are recognised.
PERIOD_KINDS = ("quarterly", "annual", "trailing_twelve_months")

_INFINITY = float("inf")


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < _INFINITY), value)


def is_finite(value: Column) -> Column:
    """True for a present, finite double; never NULL."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < _INFINITY), F.lit(False))


def positive_finite(value: Column) -> Column:
    """The value when it is a finite number above zero, else NULL; text is parsed leniently."""
    number = value.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number) & (number < _INFINITY), number)


def exchange_of(mic: Column) -> Column:
    """Exchange name of a market identifier code; NULL when unmapped."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in MIC_TO_EXCHANGE.items():
        out = out.when(mic == code, F.lit(name))
    return out


def security_type_of(raw: Column) -> Column:
    """Known security types unchanged, anything else (NULL included) as OTHER."""
    return F.when(raw.isin(*KNOWN_TYPES), raw).otherwise(F.lit(OTHER_TYPE))


def is_common(ticker_type: Column) -> Column:
    return F.coalesce(ticker_type == COMMON_STOCK, F.lit(False))


def normalize_id(raw: Column, kind: str = "string") -> Column:
    """Comparable text form of an entity id, so that 22222, 22222.0 and "0000022222" agree."""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return raw.cast("string")
    if kind in ("double", "float"):
        whole = (raw == F.floor(raw)) & (F.abs(raw) < 9.0e18)
        return F.when(F.isnan(raw), None).otherwise(
            F.when(whole, raw.try_cast("bigint").cast("string")).otherwise(raw.cast("string"))
        )
    text = F.trim(raw.cast("string"))
    as_int = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint").cast("string"))
    return F.coalesce(as_int, F.when(text != "", text))


def padded_id(raw: Column) -> Column:
    """Entity id zero-padded to ten characters; NULL when it is not a number."""
    number = raw.try_cast("bigint")
    return F.when(number.isNotNull(), F.format_string("%010d", number))


def lenient_date(raw: Column) -> Column:
    """First ten characters read as year-month-day; NULL when they are no date."""
    return F.to_date(F.try_to_timestamp(F.substring(raw.cast("string"), 1, 10), F.lit("yyyy-M-d")))


def calendar_day(raw: Column) -> Column:
    """The UTC day of a date, timestamp or date text; NULL when unreadable."""
    trimmed = F.trim(raw.cast("string"))
    text = F.when(trimmed != "", trimmed)
    zoned = text.rlike(r":[0-9]{2}([.][0-9]+)? *(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    instant = F.floor(F.unix_seconds(text.try_cast("timestamp")) / 86400).cast("int")
    return F.coalesce(
        F.when(zoned, F.date_from_unix_date(instant)),
        F.to_date(text.try_cast("timestamp_ntz")),
        F.to_date(F.try_to_timestamp(text, F.lit("MMMM d, yyyy"))),
    )


def stripped_int(raw: Column) -> Column:
    """Integer value of trimmed text without leading zeros; NULL when empty or unreadable."""
    text = F.trim(raw.cast("string"))
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(text != "", digits.try_cast("bigint"))


def clean_text(raw: Column) -> Column:
    """Trimmed text; NULL stays NULL."""
    return F.trim(raw.cast("string"))


def undotted(symbol: Column) -> Column:
    """Share-class symbols without the dot, for comparing constituent lists."""
    return F.replace(symbol, F.lit("."), F.lit(""))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def covers(start: Column, end: Column, day: Column, open_start: bool) -> Column:
    """Half-open interval test ``start <= day < end``; a NULL end is open.

    A NULL start is minus infinity only when ``open_start``; otherwise it never matches.
    The result is never NULL.
    """
    begun = (start <= day) | (start.isNull() if open_start else F.lit(False))
    return F.coalesce(begun & (end.isNull() | (day < end)), F.lit(False))
