"""Declared schemas, so that scans never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

LEVEL_FIELDS = (("px", T.DoubleType()), ("sz", T.DoubleType()), ("ordcnt", T.LongType()))


def book(depth: int = 50, symbol: bool = True, exchange_time: bool = True) -> T.StructType:
    """Wide order book with the given number of levels on either side."""
    fields = [T.StructField("symbol", T.StringType())] if symbol else []
    fields.append(T.StructField("timeMs", T.LongType()))
    if exchange_time:
        fields.append(T.StructField("exchTimeMs", T.LongType()))
    for side in ("ask", "bid"):
        for n in range(1, depth + 1):
            fields += [T.StructField(f"{side}_{n}_{name}", kind) for name, kind in LEVEL_FIELDS]
    return T.StructType(fields)


def raw_futures_book(depth: int = 50) -> T.StructType:
    """Futures files: other level names, no symbol."""
    fields = [T.StructField("timeMs", T.LongType())]
    for side in ("ask", "bid"):
        for n in range(1, depth + 1):
            fields += [T.StructField(f"{side}Px{n}", T.DoubleType()), T.StructField(f"{side}Sz{n}", T.DoubleType()), T.StructField(f"{side}Cnt{n}", T.LongType())]
    return T.StructType(fields)


TRADES = "trade_id string, timestamp bigint, instrument_name string, price double, mark_price double, index_price double, direction string, amount double, combo_trade_id string, combo_id string, block_trade_leg_count bigint, block_trade_id string, block_rfq_id string, liquidation string"
TRADES_ARCHIVE = "created_time bigint, instrument_name string, trade_id string, side string, price double, size double"
CANDLES = "open_time bigint, open double, high double, low double, close double, vol double"
FUNDING = "funding_time bigint, instrument_name string, funding_rate double"
INSTRUMENTS = "instrument_name string, expiration_timestamp bigint"
TRADE_PAGE = f"result struct<trades: array<struct<{', '.join(f'{n}: {t}' for n, t in (x.rsplit(' ', 1) for x in TRADES.split(', ')))}>>, has_more: boolean>"
ARCHIVE_INDEX = "code string, msg string, data array<struct<details: array<struct<groupDetails: array<struct<filename: string, url: string, sizeMB: double>>>>>>"
IV_POINTS = "timestamp bigint, symbol string, expiry timestamp, strike bigint, option_type string, mid_price double, forward_price double, tenor_days double, log_moneyness double, implied_vol double"
