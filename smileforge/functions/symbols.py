"""Instrument symbols as Column expressions.

Option: ``BTC-USD-250627-200000-C[.ext]``; future: ``BTC-USD-250131[.ext]``;
short option: ``BTC-31OCT25-120000-C``.  Long symbols expire at 08:00 UTC,
short ones at midnight.  ``strict`` raises on a wrong number of parts, else
all fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPIRY_HOUR = 8
#: Four groups: coin, expiry, strike, side.
SHORT_PATTERN = r"([A-Z]+)-(\d+[A-Z]+\d+)-(\d+)-([CP])"


def _parsed(name: Column, n: int, value, strict: bool) -> Column:
    """``value`` of the parts of a name, which are split once; null, or an error, if they are not ``n``."""
    bad = F.lit(None)
    if strict:
        bad = F.when(name.isNotNull(), F.raise_error(F.concat(F.lit("not a symbol: "), name)))
    parts = F.split(F.split_part(name, F.lit("."), F.lit(1)), "-")
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) == n, value(lambda k: F.try_element_at(p, F.lit(k)))).otherwise(bad))[0]


def _century(two_digits: Column) -> Column:
    """Years 69 to 99 are of the last century."""
    return F.when(two_digits >= "69", F.lit("19")).otherwise(F.lit("20"))


def _day(text: Column, hours: int = EXPIRY_HOUR) -> Column:
    """``yymmdd`` at the expiry hour; by integer arithmetic, as a formatter costs more than all else here."""
    n = text.try_cast("int")
    year = F.floor(n / 10_000)
    year = year + F.when(year >= 69, 1900).otherwise(2000)
    at = F.try_make_timestamp(year, F.floor(n / 100) % 100, n % 100, F.lit(hours), F.lit(0), F.lit(0))
    return F.when(F.lpad(n.cast("string"), 6, "0") == text, at)


def parse_option_name(name: Column, strict: bool = False) -> Column:
    """struct(family, expiry, strike, option_type)."""
    value = lambda at: F.struct(
        F.concat_ws("-", at(1), at(2)).alias("family"),
        _day(at(3)).alias("expiry"),
        at(4).try_cast("bigint").alias("strike"),
        F.upper(at(5)).alias("option_type"),
    )
    return _parsed(name, 5, value, strict)


def parse_future_name(name: Column, strict: bool = False) -> Column:
    """struct(family, expiry)."""
    return _parsed(name, 3, lambda at: F.struct(F.concat_ws("-", at(1), at(2)).alias("family"), _day(at(3)).alias("expiry")), strict)


def parse_option_instrument(name: Column) -> Column:
    """struct(expiry string, strike, option_type) of a short symbol; null if it has not four parts."""
    p = F.split(name, "-")
    at = lambda k: F.try_element_at(p, F.lit(k))
    return F.when(F.size(p) == 4, F.struct(at(2).alias("expiry"), at(3).try_cast("bigint").alias("strike"), at(4).alias("option_type")))


def short_expiry(expiry: Column) -> Column:
    """Timestamp of an expiry like ``31OCT25`` or ``1NOV25``; null if it is none."""
    part = lambda k: F.regexp_extract(expiry, r"^(\d{1,2})([A-Za-z]{3})(\d{2})$", k)
    return F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), F.concat(_century(part(3)), part(3))), F.lit("d MMM yyyy"))


def regex_symbol(name: Column, pattern: str = SHORT_PATTERN) -> Column:
    """struct(coin, expiry, strike, option_type) by pattern; null fields where it does not match."""
    group = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(group(1).alias("coin"), group(2).alias("expiry"), group(3).try_cast("bigint").alias("strike"), group(4).alias("option_type"))


def strike_and_side(name: Column, expiry: str, coin: str = "BTC") -> Column:
    """struct(strike, option_type) of the short symbols of one expiry; null for all others."""
    pattern = rf"^{coin}-{expiry}-(\d+)-([CP])"
    group = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(group(1).try_cast("bigint").alias("strike"), group(2).alias("option_type")))
