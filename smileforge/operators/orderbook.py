"""Order-book operators: column names, depth, mid price, last quote of a time bin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_ms, freq_ms, mid
from ..functions.symbols import parse_option_name

_RAW = re.compile(r"(ask|bid)(Px|Sz|Cnt)(\d+)")
_LEVEL = re.compile(r"(ask|bid)_(\d+)_\w+")
_SUFFIX = {"Px": "px", "Sz": "sz", "Cnt": "ordcnt"}


def is_book_column(name: str) -> bool:
    return name.startswith(("ask", "bid"))


def standardize_orderbook_columns(df: DataFrame, filename: str | None = None) -> DataFrame:
    """``askPx1`` becomes ``ask_1_px``, and a missing symbol is taken from the file name.

    Nothing changes if all book columns (or none) are in the standard form.
    Without ``filename`` the name of the scanned file is used.
    """
    if all(c.count("_") >= 2 for c in df.columns if is_book_column(c)):
        return df
    names = {c: f"{m[1]}_{m[3]}_{_SUFFIX[m[2]]}" for c in df.columns if (m := _RAW.fullmatch(c))}
    out = df.withColumnsRenamed(names)
    if "symbol" not in df.columns:
        source = F.lit(filename) if filename is not None else F.col("_metadata.file_name")
        with_symbol = df.withColumn("symbol", F.split_part(source, F.lit(".csv"), F.lit(1)))
        out = with_symbol.withColumnsRenamed(names).select("symbol", *out.columns)
    return out


def trim_orderbook(df: DataFrame, n_levels: int = 5) -> DataFrame:
    """Book levels up to ``n_levels``; 0 keeps two-sided rows and replaces the book by ``mid_price``."""
    base = [c for c in df.columns if not is_book_column(c)]
    if n_levels > 0:
        keep = [c for c in df.columns if not is_book_column(c) or ((m := _LEVEL.fullmatch(c)) and int(m[2]) <= n_levels)]
        return df.select(*keep)
    if not {"bid_1_px", "ask_1_px"} <= set(df.columns):
        return df.select(*base, F.lit(None).cast("double").alias("mid_price")).where(F.lit(False))
    bid, ask = F.col("bid_1_px"), F.col("ask_1_px")
    two_sided = bid.isNotNull() & ask.isNotNull() & ~F.isnan(bid) & ~F.isnan(ask)
    return df.where(two_sided).select(*base, mid(bid, ask).alias("mid_price"))


def bin_orderbook(df: DataFrame, freq: str, time: str = "timeMs", symbol: str = "symbol", order: str | None = None) -> DataFrame:
    """The last row of every (bin, symbol), with ``time_bin`` and its start in ms as ``timestamp``.

    Of rows with the same time the first by ``order`` wins, by default the first
    as read.  One aggregation: a task sorts its rows by key and sends one row of
    each bin and symbol through the shuffle.
    """
    start = floor_ms(F.col(time), freq_ms(freq))
    row = F.struct(*df.columns).alias("r")
    tie = F.col(order) if order else F.monotonically_increasing_id()
    rows = df.select(start.alias("timestamp"), F.col(symbol).alias("__symbol"), row, F.struct((-F.col(time)).alias("t"), tie.alias("tie")).alias("__o"))
    last = rows.groupBy("timestamp", "__symbol").agg(F.min_by("r", "__o").alias("r"))
    return last.select("r.*", F.timestamp_millis("timestamp").alias("time_bin"), "timestamp")


def get_option_combos(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct (expiry, strike) of option symbols, in order."""
    p = df.select(parse_option_name(F.col(column)).alias("p")).where(F.col("p").isNotNull())
    return p.select("p.expiry", "p.strike").distinct().orderBy("expiry", "strike")


def forward_curve(futures: DataFrame) -> DataFrame:
    """(timestamp, expiry, forward_price) from binned futures mids."""
    from ..functions.symbols import parse_future_name

    return futures.select("timestamp", parse_future_name(F.col("symbol"))["expiry"].alias("expiry"), F.col("mid_price").alias("forward_price"))


def with_known_expiry(options: DataFrame, forwards: DataFrame) -> DataFrame:
    """Options whose expiry has a forward (left semi join; prunes files if stored by expiry)."""
    keyed = options.withColumn("__expiry", parse_option_name(F.col("symbol"))["expiry"])
    known = forwards.select(F.col("expiry").alias("__expiry")).distinct()
    return keyed.join(known, "__expiry", "left_semi").drop("__expiry")
