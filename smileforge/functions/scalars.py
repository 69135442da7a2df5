"""Small scalar expressions: time, prices, clipping, grids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
YEAR_SECONDS = 365.25 * 24 * 3600
_UNITS = {"ms": 1, "s": 1000, "min": 60_000, "t": 60_000, "m": 60_000, "h": 3_600_000, "d": DAY_MS}


def freq_ms(freq: str) -> int:
    """Milliseconds of a step such as ``5min``, ``30s``, ``100ms``."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"not a time step: {freq!r}")
    return int(m[1] or 1) * _UNITS[m[2].lower()]


def to_ms(ts: Column) -> Column:
    """Epoch milliseconds, rounded down, of a timestamp with or without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def floor_ms(ms: Column, step: int) -> Column:
    """Start of the bin that holds ``ms``."""
    return ms - F.pmod(ms, F.lit(step))


def tenor_days(expiry: Column, at_ms: Column) -> Column:
    """Fractional days from a time in milliseconds to an expiry."""
    return (to_ms(expiry) - at_ms) / F.lit(float(DAY_MS))


def tenor_whole_days(expiry: Column, at_ms: Column) -> Column:
    """Whole days, rounded down: just past expiry is -1."""
    return F.floor(tenor_days(expiry, at_ms))


def tenor_years(expiry: Column, at_ms: Column) -> Column:
    return (to_ms(expiry) - at_ms) / F.lit(1000 * YEAR_SECONDS)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.try_divide(ask - bid, bid) * 10000


def fee_share(price: Column, flat: float = 0.0003, share: float = 0.125) -> Column:
    """Fee in percent of the price: the flat fee, but no more than a share of the price."""
    return F.try_divide(F.least(F.lit(flat), F.lit(share) * price), price) * 100


def clip(x: Column, low, high) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def null_if_zero(x: Column) -> Column:
    return F.nullif(x, F.lit(0).cast("double"))


def null_unless_zero(x: Column) -> Column:
    return F.when(x == 0, x)


def lookup(key: Column, values: dict[str, str], default: str) -> Column:
    """Value of a key in a constant map, or the default."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def staleness(age_seconds: Column, limit: float = 6 * 3600) -> Column:
    """0 (fresh) to 1 (as old as the limit or older)."""
    return clip(age_seconds / limit, 0.0, 1.0)


def marker_size(amount: Column) -> Column:
    return clip(amount / 10, 3.0, 15.0)


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` evenly spaced values, both ends included."""
    if n == 1:
        return F.array(low)
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda i: F.when(i == n - 1, high).otherwise(low + (high - low) * i / (n - 1)))


def ticks_within(values: list[float], low: Column, high: Column) -> Column:
    return F.filter(F.array(*[F.lit(v) for v in values]), lambda v: (v >= low) & (v <= high))


def number_label(x: Column, digits: int = 2) -> Column:
    """``1,234.50``."""
    return F.format_number(x, digits)


def percent_label(share: Column, digits: int = 1) -> Column:
    """``12.5%`` of a share of 0.125."""
    return F.format_string(f"%.{digits}f%%", share * 100)
