"""Trade histories in pages, and instrument lists.

Pages are JSON replies.  ``PagedTrades`` is a Python data source that follows
the cursor of a page function; saved pages are read with Spark's JSON reader.
Neighbouring pages overlap in the last timestamp, so rows are deduplicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..operators.analytics import keep_first

PAGE_SIZE = 10_000


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Trades of saved replies, one JSON document a file or, with ``lines``, a line; every trade once."""
    raw = spark.read.schema(schemas.TRADE_PAGE).option("multiLine", not lines).json(path)
    return dedup_trades(raw.select(F.explode("result.trades").alias("t")).select("t.*"))


def dedup_trades(trades: DataFrame) -> DataFrame:
    """The first row (by time, then by all columns) of every ``trade_id``."""
    return keep_first(trades, "trade_id", [F.col("timestamp"), F.xxhash64(*trades.columns)])


def read_instruments(spark: SparkSession, path: str, currency: str | None = None, kind: str | None = None) -> DataFrame:
    """Saved instrument lists, of one currency and of one kind (option or future) where asked for."""
    schema = f"result array<struct<{', '.join(x.replace(' ', ': ') for x in schemas.INSTRUMENTS.split(', '))}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    out = raw.select(F.explode("result").alias("i")).select("i.*")
    name = F.col("instrument_name")
    if currency:
        out = out.where(name.startswith(f"{currency}-"))
    if kind:
        out = out.where(F.size(F.split(name, "-")) == {"option": 4, "future": 2}[kind])
    return out


#: page(key, start, end, count) -> (rows, has_more)
PageFunction = Callable[[str, int, int | None, int], tuple[list[dict], bool]]


def all_pages(page: PageFunction, key: str, start: int, end: int | None = None, count: int = PAGE_SIZE) -> Iterator[dict]:
    """Rows of all pages in time order; the next page starts at the last row's time."""
    while True:
        rows, more = page(key, start, end, count)
        yield from rows
        if not more or not rows:
            return
        last = rows[-1]["timestamp"]
        if last == start and len(rows) >= count:
            start = last + 1  # a full page of one millisecond: a cursor that stood still would never end
        else:
            start = last


class PagedTrades(DataSource):
    """``spark.read.format("paged_trades")`` with the options keys (comma list), start, end, page_module, page_function."""

    @classmethod
    def name(cls) -> str:
        return "paged_trades"

    def schema(self) -> str:
        return schemas.TRADES

    def reader(self, schema):
        return _PagedReader(self.options)


class _Key(InputPartition):
    def __init__(self, key: str):
        self.key = key


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_Key(k.strip()) for k in self.options["keys"].split(",")]

    def read(self, partition):
        import importlib

        page = getattr(importlib.import_module(self.options["page_module"]), self.options["page_function"])
        names = [x.rsplit(" ", 1)[0] for x in schemas.TRADES.split(", ")]
        end = self.options.get("end")
        for row in all_pages(page, partition.key, int(self.options["start"]), int(end) if end else None):
            yield tuple(row.get(n) for n in names)


def get_trades(spark: SparkSession, keys: list[str], start: int, end: int | None, page_module: str, page_function: str) -> DataFrame:
    """Trades of currencies or instruments, one partition each, without duplicates.

    The page function is named by module, as executors import it.
    """
    spark.dataSource.register(PagedTrades)
    reader = spark.read.format("paged_trades").option("keys", ",".join(keys)).option("start", start).option("page_module", page_module).option("page_function", page_function)
    if end is not None:
        reader = reader.option("end", end)
    return dedup_trades(reader.load())


def get_trades_by_instrument(spark: SparkSession, instrument_names: list[str], start: int, end: int | None, page_module: str, page_function: str) -> DataFrame:
    """As ``get_trades``, with instruments as keys of the page function."""
    return get_trades(spark, instrument_names, start, end, page_module, page_function)


def one_page(spark: SparkSession, page: PageFunction, key: str, start: int, end: int | None = None, sorting: str | None = None, count: int = PAGE_SIZE) -> DataFrame:
    """One page of trades, at most ``count`` rows; ``sorting`` is asc or desc by time."""
    rows, _ = page(key, start, end, count)
    names = [x.rsplit(" ", 1)[0] for x in schemas.TRADES.split(", ")]
    out = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows[:count]], schemas.TRADES)
    return out.orderBy("timestamp" if sorting == "asc" else F.desc("timestamp")) if sorting else out
