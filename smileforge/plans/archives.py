"""Registered queries over archives that are generated from the driver's tables.

The files are written to the shared folder of the session first, as an archive
has them: one (gzip) CSV file an instrument and day, an index, pages of trades.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import black76 as b76
from ..operators.surface import construct_iv_surface
from ..sources import archive, trades
from ..sources.history import construct_iv_surface_from_archive

DAY = date(2025, 1, 10)
DAY_MS = 1736467200000
#: The last expiry has options, but no future.
EXPIRIES = ("250131", "250328", "250627", "251226")
EXPIRY_MS = (1738310400000, 1743148800000, 1751011200000, 1766736000000)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; a temporary one only where the session names none (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="smileforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/archive-{uuid.uuid4().hex}"


def write_files(df: DataFrame, folder: str, by: str, gzip: bool = True) -> list[str]:
    """One CSV file for each value of ``by`` (a bounded list of instruments), named by it; the paths written."""
    spark = df.sparkSession
    parts = f"{folder}.parts"
    df.repartition(by).write.partitionBy(by).option("header", True).option("compression", "gzip" if gzip else "none").csv(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    out = []
    for d in fs.listStatus(path(parts)):
        if not d.isDirectory():
            continue
        for f in fs.listStatus(d.getPath()):
            name = f.getPath().getName()
            if name.startswith("part-"):
                target = path(f"{folder}/{d.getPath().getName().split('=', 1)[1]}.csv{'.gz' if gzip else ''}")
                fs.rename(f.getPath(), target)
                out.append(target.toString())
    fs.delete(path(parts), True)
    return sorted(out)


def _spread(key):
    """A time of the day for a number, another one for every number below 86 400 000."""
    return F.lit(DAY_MS) + key * 7919 % 86_400_000


def books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order books of one day, each with the name of its instrument as ``file``: options from lineitem with a known volatility, raw futures from orders."""
    c = F.col
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = c("l_linenumber") % 4
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (k + 1).cast("int"))
    rows = item.select(pick(EXPIRIES).alias("day"), pick(EXPIRY_MS).alias("due"), (F.lit(100000.0) + k * 1000).alias("f"), (F.lit(99000) + c("l_quantity").cast("bigint") % 5 * 1000).alias("strike"),
        F.when(c("l_linenumber") % 2 == 0, "C").otherwise("P").alias("side"), _spread(c("l_orderkey") * 8 + c("l_linenumber")).alias("timeMs"), (F.lit(0.4) + c("l_orderkey") % 40 / 100).alias("vol"), (c("l_returnflag") == "R").alias("one_sided"))
    years = (c("due") - (c("timeMs") - c("timeMs") % 300_000)) / F.lit(86_400_000 * 365.25)
    coin = b76.black76_price(c("f"), c("strike").cast("double"), years, F.lit(0.0), c("vol"), c("side")) / c("f")
    name = F.concat_ws("-", F.lit("BTC-USD"), c("day"), c("strike").cast("string"), c("side"))
    options = rows.withColumn("mid", coin).select(name.alias("symbol"), "timeMs", c("timeMs").alias("exchTimeMs"), F.when(~c("one_sided"), c("mid") * 1.01).alias("ask_1_px"), F.lit(1.0).alias("ask_1_sz"), F.lit(1).alias("ask_1_ordcnt"),
        (c("mid") * 0.99).alias("bid_1_px"), F.lit(1.0).alias("bid_1_sz"), F.lit(1).alias("bid_1_ordcnt"), name.alias("file"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = (c("o_orderkey") % 3).cast("int")
    futures = o.select(_spread(c("o_orderkey") * 8).alias("timeMs"), *[(F.lit(100000.0) + at * 1000 + d).alias(n) if d else F.lit(1).alias(n) for n, d in (("askPx1", 10), ("askSz1", 0), ("askCnt1", 0), ("bidPx1", -10), ("bidSz1", 0), ("bidCnt1", 0))],
        F.concat(F.lit("BTC-USD-"), F.element_at(F.array(*[F.lit(x) for x in EXPIRIES[:3]]), at + 1)).alias("file"))
    return options, futures


def book_files(spark: SparkSession, sf_dir: str, folder: str) -> list[str]:
    """The books as files, and a future of a family that is not asked for."""
    options, futures = books(spark, sf_dir)
    other = futures.where("file = 'BTC-USD-250131'").withColumn("file", F.lit("BTC-USDC-250131"))
    return write_files(options, f"{folder}/options", "file") + write_files(futures.unionByName(other), f"{folder}/futures", "file")


def _points(iv: DataFrame) -> DataFrame:
    return iv.select("timestamp", "symbol", F.col("expiry").cast("timestamp_ntz").alias("expiry"), "strike", "option_type", "forward_price", F.round("tenor_days", 9).alias("tenor_days"), F.round("implied_vol", 4).alias("implied_vol"))


def book_iv_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From frames of books to IV points: options of expiries without a future leave by a semi join."""
    options, futures = books(spark, sf_dir)
    return _points(construct_iv_surface(options.drop("file"), futures.withColumnRenamed("file", "symbol"), "5min"))


def archive_iv_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an index of gzip books to IV points: futures of one family, options of known expiries, last two-sided quote of a bin."""
    folder = scratch(spark)
    paths = book_files(spark, sf_dir, folder)
    lister = {}
    for kind in ("futures", "options"):
        files = [{"filename": p.rsplit("/", 1)[-1], "url": p, "sizeMB": 1.0} for p in paths if f"/{kind}/" in p]
        reply = json.dumps({"code": "0", "msg": "", "data": [{"details": [{"groupDetails": files}]}]})
        spark.createDataFrame([(reply,)], "value string").coalesce(1).write.text(f"{folder}/index-{kind}-{DAY_MS}")
        lister[kind] = archive.index_lister(spark, f"{folder}/index-{kind}-{{begin}}")
    out = construct_iv_surface_from_archive(spark, folder, "BTC-USD", DAY, 1, 5, file_depth=1, lister=lister["futures"], options_lister=lister["options"])
    return _points(out)


_AT = f"{DAY_MS} + (l_orderkey * 8 + l_linenumber) * 7919 % 86400000"
ARCHIVE_IV_SQL = f"""
WITH x AS (SELECT 0 AS k, '{EXPIRIES[0]}' AS day, {EXPIRY_MS[0]} AS due UNION ALL SELECT 1, '{EXPIRIES[1]}', {EXPIRY_MS[1]} UNION ALL SELECT 2, '{EXPIRIES[2]}', {EXPIRY_MS[2]}),
o AS (SELECT {_AT} AS ms, day, due, 100000.0::DOUBLE + k * 1000 AS f, 99000 + l_quantity::BIGINT % 5 * 1000 AS strike, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS side, 0.4::DOUBLE + l_orderkey % 40 / 100 AS vol
  FROM lineitem JOIN x ON l_linenumber % 4 = k WHERE l_returnflag <> 'R'),
q AS (SELECT *, row_number() OVER (PARTITION BY ms - ms % 300000, day, strike, side ORDER BY ms DESC) AS r FROM o),
f AS (SELECT DISTINCT day, t - t % 300000 AS bin FROM (SELECT o_orderkey % 3 AS k, {DAY_MS} + o_orderkey * 8 * 7919 % 86400000 AS t FROM orders) JOIN x USING (k))
SELECT bin AS timestamp, 'BTC-USD-' || day || '-' || strike || '-' || side AS symbol, strptime(day, '%y%m%d') + INTERVAL 8 HOUR AS expiry, strike, side AS option_type, q.f AS forward_price,
  round((due - bin) / 86400000.0::DOUBLE, 9) AS tenor_days, round(vol, 4) AS implied_vol FROM q JOIN f USING (day) WHERE r = 1 AND bin = ms - ms % 300000"""


def archive_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles (module 2) from plain CSV files, one a day, without those of no volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    v = F.col("value")
    rows = e.select((F.col("event_id") * 60_000).alias("open_time"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(v + 1).alias("vol"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd").alias("file"))
    paths = write_files(rows, f"{scratch(spark)}/candles", "file", gzip=False)
    return archive.read_module(spark, 2, paths).where(~F.col("vol").eqNullSafe(0.0)).select("open_time", "close", "vol")


ARCHIVE_CANDLES_SQL = "SELECT event_id * 60000 AS open_time, value AS close, value + 1 AS vol FROM events WHERE event_id % 5 <> 0"


def trade_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from saved pages of a hundred, neighbours overlapping in one trade; every trade once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    page = F.floor(F.col("event_id") / 100)
    trade = F.struct(F.col("event_id").cast("string").alias("trade_id"), F.col("event_id").alias("timestamp"), F.col("user_id").cast("string").alias("instrument_name"), F.col("value").alias("price"), F.col("value").alias("amount"))
    on = F.explode(F.when(F.col("event_id") % 100 == 0, F.array(page, page - 1)).otherwise(F.array(page))).alias("page")
    pages = e.select(on, trade.alias("t")).groupBy("page").agg(F.sort_array(F.collect_list("t")).alias("trades"))
    folder = f"{scratch(spark)}/pages"
    pages.select(F.to_json(F.struct(F.struct("trades", F.lit(True).alias("has_more")).alias("result"))).alias("value")).write.text(folder)
    return trades.read_pages(spark, folder, lines=True).select("trade_id", "timestamp", "instrument_name", "price")


TRADE_PAGES_SQL = "SELECT event_id::VARCHAR AS trade_id, event_id AS timestamp, user_id::VARCHAR AS instrument_name, value AS price FROM events"

QUERIES = {"archive_iv_surface": archive_iv_surface, "book_iv_surface": book_iv_surface, "archive_candles": archive_candles, "trade_pages": trade_pages}
ORACLE_SQL = {"archive_iv_surface": ARCHIVE_IV_SQL, "book_iv_surface": ARCHIVE_IV_SQL, "archive_candles": ARCHIVE_CANDLES_SQL, "trade_pages": TRADE_PAGES_SQL}
