"""IV points straight from an archive of order books."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import EXPIRY_HOUR
from ..operators.orderbook import bin_orderbook, forward_curve
from ..operators.surface import compute_option_iv
from .archive import fetch_market_data
from .planner import BOOK_MODULE


def file_expiry(filename: str) -> datetime | None:
    """Expiry in the name of an option file; None if it is no option's."""
    parts = filename.split(".")[0].split("-")
    try:
        return datetime.combine(datetime.strptime(parts[2], "%y%m%d"), time(EXPIRY_HOUR)) if len(parts) == 5 else None
    except ValueError:
        return None


def construct_iv_surface_from_archive(
    spark: SparkSession,
    root: str,
    inst_family: str,
    start_date: date,
    num_days: int = 1,
    time_step_minutes: int = 5,
    risk_free_rate: float = 0.0,
    file_depth: int = 50,
    lister: Callable[[int, int], list] | None = None,
    options_lister: Callable[[int, int], list] | None = None,
) -> DataFrame:
    """IV points of a family over whole days of archived books.

    Futures come first; option files whose expiry has no forward are never
    opened.  The known expiries come to the driver: there are as many as
    futures files, which the driver has listed before.
    """
    freq, end = f"{time_step_minutes}min", start_date + timedelta(days=num_days)

    def book(kind: str, keep: Callable[[str], bool] | None, files) -> DataFrame:
        quotes = fetch_market_data(spark, root, BOOK_MODULE, kind, inst_family, start_date, end, depth=0, file_depth=file_depth, include_criterion=keep, lister=files)
        return bin_orderbook(quotes, freq)

    forwards = forward_curve(book("FUTURES", None, lister)).where(F.col("expiry").isNotNull())
    # As text, so that no zone of the driver's clock comes in.
    known = {r[0] for r in forwards.select(F.date_format("expiry", "yyyy-MM-dd HH:mm:ss")).distinct().collect()}
    options = book("OPTION", lambda name: str(file_expiry(name)) in known, options_lister or lister)
    return compute_option_iv(options, forwards, risk_free_rate)
