"""Planning of date chunks for archive requests."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

#: Order-book archive module; the others count days in UTC+8.
BOOK_MODULE = 6


def module_zone(module: int) -> timezone:
    return timezone.utc if module == BOOK_MODULE else timezone(timedelta(hours=8))


def create_date_chunks(start: date | datetime, end: date | datetime, module: int, date_aggr_type: str = "daily") -> list[tuple[int, int]]:
    """(first ms, last ms) of request chunks over whole days: 1 day for books, else 20 (daily) or 500.

    Only the date part counts.  An end at midnight excludes that day, as does
    a plain date; any later end includes it.
    """
    zone = module_zone(module)
    first = start.date() if isinstance(start, datetime) else start
    if isinstance(end, datetime):
        last = end.date() - timedelta(days=1) if end.time() == time(0) else end.date()
    else:
        last = end - timedelta(days=1)
    days = 1 if module == BOOK_MODULE else 20 if date_aggr_type == "daily" else 500
    out = []
    while first <= last:
        stop = min(first + timedelta(days=days - 1), last)
        begin = datetime.combine(first, time(0), zone)
        finish = datetime.combine(stop, time(23, 59, 59), zone)
        out.append((int(begin.timestamp() * 1000), int(finish.timestamp() * 1000)))
        first = stop + timedelta(days=1)
    return out
