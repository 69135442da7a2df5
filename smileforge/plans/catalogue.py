"""Registered queries: the operators over the driver's tables, and their SQL.

Roles on ``events``: symbol is ``user_id``, time is ``ts``, side is
``event_type``, price is ``value``.  Roles on ``lineitem``: expiry is
``l_shipdate``, strike is ``l_quantity * 1000``, amount is ``l_quantity``,
price is ``l_extendedprice``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import black76 as b76
from ..functions import scalars as s
from ..functions import symbols as sym
from ..operators import analytics as a
from ..operators import asof, orderbook, plots, surface
from ..sources.planner import create_date_chunks
from . import archives, streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(scan: DataFrame) -> DataFrame:
    """A scan dealt over all cores where it has fewer partitions, for expressions that cost more than a shuffle of their input."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``ms``, epoch milliseconds rounded down."""
    return _t(spark, sf_dir, "events").withColumn("ms", s.to_ms(F.col("ts")))


_E = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"
_DAY = "strftime(l_shipdate, '%Y-%m-%d')"


def _day(c: str = "l_shipdate"):
    return F.date_format(c, "yyyy-MM-dd")


# ---- aggregations ----


@_query("""
SELECT l_shipdate AS expiry, round(sum(l_quantity), 2) AS volume, round(sum(l_quantity * l_extendedprice), 2) AS value
FROM lineitem GROUP BY l_shipdate ORDER BY sum(l_quantity) DESC, l_shipdate LIMIT 10""")
def volume_by_expiry_top10(spark, sf_dir):
    out = a.volume_by(_t(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "l_extendedprice")
    return out.select(F.col("l_shipdate").alias("expiry"), F.round("volume", 2).alias("volume"), F.round("value", 2).alias("value"))


@_query("""
SELECT user_id, count(*) AS n, round_even(avg(value), 2) AS value_mean, round_even(stddev_samp(value), 2) AS value_std
FROM events GROUP BY user_id""")
def market_stats_by_symbol(spark, sf_dir):
    return a.stats_by(_t(spark, sf_dir, "events"), "user_id", ["value"])


@_query("""
WITH q AS (SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS bid, l_extendedprice AS ask, l_quantity FROM lineitem),
x AS (SELECT l_suppkey, round_even(avg(ask - bid), 4) AS spread_mean, round_even(stddev_samp(ask - bid), 4) AS spread_std,
  round_even(avg((ask - bid) / bid * 10000), 4) AS spread_bps_mean, round_even(stddev_samp((ask - bid) / bid * 10000), 4) AS spread_bps_std
  FROM q GROUP BY 1),
y AS (SELECT l_suppkey, count(*) AS n, round_even(avg(l_quantity), 4) AS l_quantity_mean, round_even(stddev_samp(l_quantity), 4) AS l_quantity_std FROM q GROUP BY 1)
SELECT * FROM x FULL JOIN y USING (l_suppkey)""")
def spread_stats(spark, sf_dir):
    q = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bid"), F.col("l_extendedprice").alias("ask"))
    q = q.withColumns({"spread": F.col("ask") - F.col("bid"), "spread_bps": s.spread_bps(F.col("bid"), F.col("ask"))})
    x = a.stats_by(q, "l_suppkey", ["spread", "spread_bps"], 4).drop("n")
    return a.full_outer(x, a.stats_by(q, "l_suppkey", ["l_quantity"], 4), "l_suppkey")


@_query("""
SELECT l_shipdate AS expiry, min(l_quantity * 1000)::BIGINT AS low, max(l_quantity * 1000)::BIGINT AS high, count(*) AS n
FROM lineitem GROUP BY 1""")
def strike_range_by_expiry(spark, sf_dir):
    k = (F.col("l_quantity") * 1000).cast("bigint")
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("expiry")).agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count(F.lit(1)).alias("n"))


def _option_symbols(spark, sf_dir) -> DataFrame:
    strike = (F.col("l_quantity") * 1000).cast("bigint").cast("string")
    side = F.when(F.col("l_linenumber") % 2 == 0, "c").otherwise("P")
    items = _spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"))
    return items.select("l_orderkey", "l_linenumber", F.concat(F.lit("BTC-USD-"), F.date_format("l_shipdate", "yyMMdd"), F.lit("-"), strike, F.lit("-"), side, F.lit(".OK")).alias("symbol"))


_SYMBOLS = """sy AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity,
  'BTC-USD-' || strftime(l_shipdate, '%y%m%d') || '-' || (l_quantity * 1000)::BIGINT || '-' || CASE WHEN l_linenumber % 2 = 0 THEN 'c' ELSE 'P' END || '.OK' AS symbol FROM lineitem),
pa AS (SELECT *, string_split(split_part(symbol, '.', 1), '-') AS p FROM sy)"""


@_query(f"""
WITH {_SYMBOLS} SELECT DISTINCT strptime(p[3], '%y%m%d') + INTERVAL 8 HOUR AS expiry, p[4]::BIGINT AS strike FROM pa""")
def distinct_combos(spark, sf_dir):
    out = orderbook.get_option_combos(_option_symbols(spark, sf_dir))
    return out.select(F.col("expiry").cast("timestamp_ntz").alias("expiry"), "strike")


@_query("""
SELECT count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM (SELECT l_extendedprice::DOUBLE AS v FROM lineitem)""")
def describe_price(spark, sf_dir):
    out = a.describe(_t(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


@_query("""
WITH f AS (SELECT least(0.0003::DOUBLE, 0.125::DOUBLE * v) / v * 100 AS fee FROM (SELECT value / 100000 AS v FROM events) WHERE v <> 0)
SELECT count(fee) AS count, round(avg(fee), 6) AS mean, round(stddev_samp(fee), 6) AS std, round(min(fee), 6) AS min, round(quantile_cont(fee, 0.25), 6) AS p25,
  round(quantile_cont(fee, 0.5), 6) AS p50, round(quantile_cont(fee, 0.75), 6) AS p75, round(max(fee), 6) AS max FROM f""")
def fee_share_stats(spark, sf_dir):
    out = a.describe(_t(spark, sf_dir, "events").select(s.fee_share(F.col("value") / 100000).alias("fee")), "fee")
    return out.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@_query("""
SELECT count(l_discount) AS n, count(*) FILTER (l_discount < 0.02) AS n_low, round(count(*) FILTER (l_discount < 0.02) * 100.0::DOUBLE / count(*), 6) AS share_low,
  count(*) FILTER (l_discount >= 0.02 AND l_discount < 0.05) AS n_mid, round(count(*) FILTER (l_discount >= 0.02 AND l_discount < 0.05) * 100.0::DOUBLE / count(*), 6) AS share_mid,
  count(*) FILTER (l_discount >= 0.05) AS n_high, round(count(*) FILTER (l_discount >= 0.05) * 100.0::DOUBLE / count(*), 6) AS share_high FROM lineitem""")
def value_bands(spark, sf_dir):
    out = a.band_shares(_t(spark, sf_dir, "lineitem"), "l_discount", {"low": (None, 0.02), "mid": (0.02, 0.05), "high": (0.05, None)})
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("share") else F.col(c) for c in out.columns])


@_query("\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, (count(*) - count({c}))::BIGINT AS nulls, (count(*) - count({c}))::DOUBLE / count(*) AS share FROM events" for c, t in (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))))
def column_profile(spark, sf_dir):
    return a.profile(_t(spark, sf_dir, "events"))


@_query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT value) AS value FROM events")
def distinct_counts(spark, sf_dir):
    return a.distinct_counts(_t(spark, sf_dir, "events"), ["user_id", "event_type", "value"])


@_query("SELECT min(ts) AS first, max(ts) AS last, max(value) - min(value) AS value_range, round(avg(value - user_id), 6) AS mean_diff FROM events")
def global_range(spark, sf_dir):
    return _t(spark, sf_dir, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), (F.max("value") - F.min("value")).alias("value_range"), F.round(F.avg(F.col("value") - F.col("user_id")), 6).alias("mean_diff"))


@_query(f"WITH {_E} SELECT user_id, ms - ms % 3600000 AS timestamp, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1")
def duplicate_bins(spark, sf_dir):
    return a.duplicates(_events(spark, sf_dir).select("user_id", s.floor_ms(F.col("ms"), 3_600_000).alias("timestamp")), ["user_id", "timestamp"])


@_query("""
WITH u AS (SELECT event_id, user_id, value FROM events UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 0)
SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value, user_id) AS r FROM u) WHERE r = 1""")
def dedup_trades(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return a.keep_first(a.union_all(e, e.where("event_id % 3 = 0")), "event_id", [F.col("value"), F.col("user_id")])


@_query("""
WITH u AS (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0)
SELECT count(*) AS rows, count(DISTINCT event_id) AS kept, count(*) - count(DISTINCT event_id) AS dropped FROM u""")
def dedup_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id")
    return a.dropped_duplicates(a.union_all(e, e.where("event_id % 3 = 0")), "event_id")


@_query(f"WITH {_E} SELECT max(n) AS n FROM (SELECT count(*) AS n FROM e GROUP BY user_id, ms - ms % 3600000)")
def largest_bin(spark, sf_dir):
    return a.largest_group(_events(spark, sf_dir).select("user_id", s.floor_ms(F.col("ms"), 3_600_000).alias("timestamp")), ["user_id", "timestamp"])


@_query("""
SELECT user_id, count(*) AS n, round_even(avg(value), 2) AS value_mean, round_even(stddev_samp(value), 2) AS value_std
FROM events GROUP BY user_id ORDER BY value_mean DESC, user_id LIMIT 5""")
def market_stats_top5(spark, sf_dir):
    """The five symbols of highest mean (a report): order by an aggregate."""
    return a.stats_by(_t(spark, sf_dir, "events"), "user_id", ["value"], sort_by="value_mean").limit(5)


@_query("""
SELECT count(*) AS rows, 6::BIGINT AS columns, sum(8 * ((event_id IS NOT NULL)::INT + (ts IS NOT NULL)::INT + (user_id IS NOT NULL)::INT + (value IS NOT NULL)::INT)
  + coalesce(strlen(event_type), 0) + coalesce(strlen(props), 0))::BIGINT AS bytes FROM events""")
def size_summary(spark, sf_dir):
    return a.size_summary(_t(spark, sf_dir, "events"))


@_query("SELECT o_orderkey * 1000 AS timestamp, date_trunc('day', o_orderdate) + INTERVAL 8 HOUR AS expiry, o_totalprice AS forward_price FROM orders")
def forward_curve(spark, sf_dir):
    """Forward prices from futures mids by symbol."""
    futures = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000).alias("timestamp"), F.concat(F.lit("BTC-USD-"), F.date_format("o_orderdate", "yyMMdd")).alias("symbol"), F.col("o_totalprice").alias("mid_price"))
    return orderbook.forward_curve(futures).withColumn("expiry", F.col("expiry").cast("timestamp_ntz"))


@_query("""
SELECT event_id AS id, value AS price, NULL::VARCHAR AS flag FROM events UNION ALL SELECT l_orderkey AS id, l_extendedprice AS price, l_returnflag AS flag FROM lineitem""")
def union_pages(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("price"))
    return a.union_all(e, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")))


# ---- order book ----

_BIN = """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
r AS (SELECT *, ms - ms % {step} AS timestamp, row_number() OVER (PARTITION BY user_id, ms - ms % {step} ORDER BY ms DESC, event_id) AS r FROM e)
SELECT user_id, timestamp, ms, event_id, value FROM r WHERE r = 1"""


def _last_quotes(spark, sf_dir, freq: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "ms", "event_id", "value")
    return orderbook.bin_orderbook(e, freq, time="ms", symbol="user_id", order="event_id").select("user_id", "timestamp", "ms", "event_id", "value")


@_query(_BIN.format(step=300_000))
def bin_last_quote_5min(spark, sf_dir):
    return _last_quotes(spark, sf_dir, "5min")


@_query(_BIN.format(step=3_600_000))
def bin_last_quote_1h(spark, sf_dir):
    return _last_quotes(spark, sf_dir, "1h")


@_query("""
SELECT l_orderkey, l_linenumber, (bid + ask) / 2 AS mid_price
FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_extendedprice * (1 - l_discount) END AS bid, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS ask FROM lineitem)
WHERE bid IS NOT NULL AND ask IS NOT NULL""")
def depth_trim_mid(spark, sf_dir):
    book = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bidPx1"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("askPx1"), F.col("l_quantity").alias("askSz2"))
    return orderbook.trim_orderbook(orderbook.standardize_orderbook_columns(book, "BTC-USD-250131.csv.gz"), 0).drop("symbol")


@_query("""
SELECT l_orderkey, l_linenumber, 'BTC-USD-250131' AS symbol, l_extendedprice AS ask_1_px, l_quantity AS ask_2_sz FROM lineitem""")
def depth_trim_levels(spark, sf_dir):
    book = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("askPx1"), F.col("l_quantity").alias("askSz2"), F.col("l_tax").alias("bidPx3"))
    return orderbook.trim_orderbook(orderbook.standardize_orderbook_columns(book, "BTC-USD-250131.csv.gz"), 2)


# ---- symbols ----


@_query(f"""
WITH {_SYMBOLS} SELECT l_orderkey, l_linenumber, p[1] || '-' || p[2] AS family, strptime(p[3], '%y%m%d') + INTERVAL 8 HOUR AS expiry, p[4]::BIGINT AS strike, upper(p[5]) AS option_type FROM pa""")
def parse_option_symbol(spark, sf_dir):
    out = _option_symbols(spark, sf_dir).select("l_orderkey", "l_linenumber", sym.parse_option_name(F.col("symbol"), strict=True).alias("p")).select("l_orderkey", "l_linenumber", "p.*")
    return out.withColumn("expiry", F.col("expiry").cast("timestamp_ntz"))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'BTC-USD' END AS family,
  CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('day', o_orderdate) + INTERVAL 8 HOUR END AS expiry FROM orders""")
def parse_future_symbol(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 5 == 0, F.lit("BTC-PERPETUAL")).otherwise(F.concat(F.lit("BTC-USD-"), F.date_format("o_orderdate", "yyMMdd"), F.lit(".OK")))
    out = _t(spark, sf_dir, "orders").select("o_orderkey", sym.parse_future_name(name).alias("p")).select("o_orderkey", "p.*")
    return out.withColumn("expiry", F.col("expiry").cast("timestamp_ntz"))


def _short(kind: str = "spark"):
    return F.when(F.col("l_linenumber") == 1, F.concat(F.lit("BTC-"), F.upper(F.date_format("l_shipdate", "dMMMyy")))).otherwise(F.concat(F.lit("BTC-"), F.upper(F.date_format("l_shipdate", "dMMMyy")), F.lit("-"), (F.col("l_quantity") * 1000).cast("bigint").cast("string"), F.lit("-C")))


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN upper(strftime(l_shipdate, '%-d%b%y')) END AS expiry,
  CASE WHEN l_linenumber <> 1 THEN (l_quantity * 1000)::BIGINT END AS strike, CASE WHEN l_linenumber <> 1 THEN 'C' END AS option_type,
  CASE WHEN l_linenumber <> 1 THEN date_trunc('day', l_shipdate) END AS expires_at FROM lineitem""")
def parse_short_symbol(spark, sf_dir):
    out = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sym.parse_option_instrument(_short()).alias("p")).select("l_orderkey", "l_linenumber", "p.*")
    return out.withColumn("expires_at", sym.short_expiry(F.col("expiry")).cast("timestamp_ntz"))


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN 'BTC' END AS coin, CASE WHEN l_linenumber <> 1 THEN upper(strftime(l_shipdate, '%-d%b%y')) END AS expiry,
  CASE WHEN l_linenumber <> 1 THEN (l_quantity * 1000)::BIGINT END AS strike, CASE WHEN l_linenumber <> 1 THEN 'C' END AS option_type FROM lineitem""")
def regex_symbol(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sym.regex_symbol(_short()).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


# ---- filters, small scalars ----


@_query("SELECT event_id, value FROM events WHERE event_type NOT LIKE 'p%' AND NOT (value = 0) AND contains(event_type, 'i')")
def predicate_filters(spark, sf_dir):
    return _t(spark, sf_dir, "events").where(~F.col("event_type").startswith("p") & ~F.col("value").eqNullSafe(0) & F.col("event_type").contains("i")).select("event_id", "value")


@_query("SELECT count(*) AS n FROM (SELECT CASE WHEN l_linenumber <> 3 THEN 1 END AS bid, CASE WHEN l_returnflag <> 'R' THEN 1 END AS ask FROM lineitem) WHERE bid IS NULL OR ask IS NULL")
def one_sided_quotes(spark, sf_dir):
    q = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, 1).alias("bid"), F.when(F.col("l_returnflag") != "R", 1).alias("ask"))
    return q.where(F.col("bid").isNull() | F.col("ask").isNull()).agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'green' WHEN 'view' THEN 'red' ELSE 'gray' END AS colour, least(greatest(value / 10, 3), 15)::DOUBLE AS size,
  least(greatest(value / 500, 0), 1)::DOUBLE AS fade, CASE WHEN user_id = 0 THEN NULL ELSE user_id::DOUBLE END AS masked FROM events""")
def marker_columns(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", s.lookup(F.col("event_type"), {"click": "green", "view": "red"}, "gray").alias("colour"), s.marker_size(F.col("value")).alias("size"), s.clip(F.col("value") / 500, 0.0, 1.0).alias("fade"), s.null_if_zero(F.col("user_id").cast("double")).alias("masked"))


@_query("SELECT DISTINCT event_type, strftime(date_trunc('hour', ts), '%m-%d %Hh') AS label FROM events ORDER BY ALL")
def hour_labels(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_type", F.date_format(F.date_trunc("hour", "ts"), "MM-dd HH'h'").alias("label")).distinct().orderBy("event_type", "label")


@_query("WITH t AS (SELECT DISTINCT ts FROM events) SELECT ts AS middle FROM t ORDER BY ts LIMIT 1 OFFSET (SELECT count(*) // 2 FROM t)")
def middle_timestamp(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return a.middle_time(e, "us").select(F.timestamp_micros("middle").cast("timestamp_ntz").alias("middle"))


@_query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events) WHERE i <= 100 AND (i - 1) % 10 = 0")
def strided_sample(spark, sf_dir):
    return a.every_nth(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id")


@_query("SELECT min_by(event_id, ts) AS first_id, max_by(event_id, ts) AS last_id FROM events")
def first_last_row(spark, sf_dir):
    return _t(spark, sf_dir, "events").agg(F.min_by("event_id", "ts").alias("first_id"), F.max_by("event_id", "ts").alias("last_id"))


# ---- joins ----

_LIMIT = 6 * 3600 * 1000


@_query(f"""
WITH {_E}, m AS (SELECT max(ms) AS t FROM e),
n AS (SELECT * FROM e, m WHERE ms BETWEEN t - {_LIMIT} AND t),
k AS (SELECT user_id, max(ms) AS last, any_value(t) AS t FROM n GROUP BY 1),
v AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC) AS r FROM n WHERE user_id % 7 <> 0) WHERE r = 1)
SELECT k.user_id, v.value, (t - last) / 1000.0::DOUBLE AS age_seconds FROM k LEFT JOIN v USING (user_id)""")
def asof_latest(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("value", F.when(F.col("user_id") % 7 != 0, F.col("value")))
    at = e.agg(F.max("ms")).first()[0] or 0
    return asof.latest_at(e, at, ["user_id"], "ms", ["value"], _LIMIT)


@_query(f"""
WITH {_E}, g AS (SELECT unnest(range(a, b + 3600000, 3600000)) AS t FROM (SELECT min(ms) AS a, max(ms) AS b FROM e)),
u AS (SELECT DISTINCT user_id FROM e), x AS (SELECT user_id, t FROM u CROSS JOIN g)
SELECT x.user_id, x.t AS ms, e.value, (x.t - e.ms) / 1000.0::DOUBLE AS age_seconds
FROM x ASOF JOIN e ON x.user_id = e.user_id AND x.t >= e.ms WHERE x.t - e.ms <= {_LIMIT}""")
def asof_grid_6h(spark, sf_dir):
    out = asof.asof_grid(_events(spark, sf_dir).select("user_id", "ms", "value"), ["user_id"], "ms", ["value"], 3_600_000, _LIMIT)
    return out.select("user_id", "ms", "value", "age_seconds")


_CENTER = 1705276800000


@_query(f"WITH {_E} SELECT event_id, user_id, (ms - {_CENTER}) / 1000.0::DOUBLE AS time_offset FROM e WHERE ms BETWEEN {_CENTER} - 36000000 AND {_CENTER} + 36000000")
def trade_window(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("instrument_name", F.lit("BTC-31OCT25-120000-C"))
    return asof.trades_window(e, _CENTER, 600, "ms").select("event_id", "user_id", "time_offset")


@_query(f"""
WITH {_E} SELECT e.event_id, c.ms AS center, (e.ms - c.ms) / 1000.0::DOUBLE AS time_offset FROM e JOIN e c ON e.ms BETWEEN c.ms - 600000 AND c.ms + 600000""")
def trade_windows_many(spark, sf_dir):
    """Trades around every event."""
    e = _events(spark, sf_dir)
    return asof.windows_around(e, e.select(F.col("ms").alias("center")), 600_000, "ms").select("event_id", "center", "time_offset")


@_query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate = o_orderdate AND l_returnflag = 'R')""")
def symbol_semi_join(spark, sf_dir):
    known = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_shipdate").alias("o_orderdate")).distinct()
    return _t(spark, sf_dir, "orders").join(known, "o_orderdate", "left_semi").select("o_orderkey", "o_orderdate")


_FORWARD = f"""{_SYMBOLS},
fw AS (SELECT date_trunc('day', o_orderdate) + INTERVAL 8 HOUR AS expiry, round(avg(o_totalprice), 6) AS forward_price FROM orders GROUP BY 1),
jo AS (SELECT l_orderkey, l_linenumber, strptime(p[3], '%y%m%d') + INTERVAL 8 HOUR AS expiry, p[4]::BIGINT AS strike, upper(p[5]) AS option_type FROM pa)"""


def _forwards(spark, sf_dir) -> DataFrame:
    expiry = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 8 HOURS")
    return _t(spark, sf_dir, "orders").groupBy(expiry.alias("expiry")).agg(F.round(F.avg("o_totalprice"), 6).alias("forward_price"))


@_query(f"WITH {_FORWARD} SELECT l_orderkey, l_linenumber, strike, option_type, forward_price, round(ln(strike / forward_price), 9) AS log_moneyness FROM jo JOIN fw USING (expiry)")
def forward_join(spark, sf_dir):
    o = _option_symbols(spark, sf_dir).select("l_orderkey", "l_linenumber", sym.parse_option_name(F.col("symbol")).alias("p")).select("l_orderkey", "l_linenumber", "p.expiry", "p.strike", "p.option_type")
    out = surface.join_parsed(o, _forwards(spark, sf_dir), "expiry")
    return out.select("l_orderkey", "l_linenumber", "strike", "option_type", "forward_price", F.round(b76.log_moneyness(F.col("strike"), F.col("forward_price")), 9).alias("log_moneyness"))


@_query("""
SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate + INTERVAL 8 HOUR) // 1000 - 788918400000) / 86400000.0::DOUBLE AS tenor_days,
  floor((epoch_us(l_shipdate + INTERVAL 8 HOUR) // 1000 - 946684800000) / 86400000.0::DOUBLE)::BIGINT AS whole_days,
  round((epoch_us(l_shipdate) // 1000 - 788918400000) / 31557600000.0::DOUBLE, 9) AS tenor_years FROM lineitem""")
def tenor(spark, sf_dir):
    at8 = F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 8 HOURS")
    t0 = F.lit(788918400000)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.tenor_days(at8, t0).alias("tenor_days"), s.tenor_whole_days(at8, F.lit(946684800000)).cast("bigint").alias("whole_days"), F.round(s.tenor_years(F.col("l_shipdate"), t0), 9).alias("tenor_years"))


# ---- Black-76 ----


def _terms(spark, sf_dir) -> DataFrame:
    """Forward, strike, years, volatility and side from line items."""
    items = _spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_tax"))
    return items.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("f"), (F.col("l_extendedprice") * (F.lit(0.95) + F.col("l_discount"))).alias("k"),
        (F.lit(0.5) + F.col("l_quantity") / 50).alias("t"), (F.lit(0.2) + F.col("l_tax") * 5).alias("sigma"), F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P").alias("side"),
    )


def _sql_poly(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({x} * {out} + {c!r})"
    return out


def _sql_cdf(x: str) -> str:
    q = f"abs({x})"
    upper = f"(exp(-{x} * {x} / 2) * {_sql_poly(q, b76._TOP)} / {_sql_poly(q, b76._BOTTOM)})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


_TERMS = """te AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS f, (l_extendedprice * (0.95::DOUBLE + l_discount))::DOUBLE AS k, (0.5::DOUBLE + l_quantity / 50)::DOUBLE AS t,
  (0.2::DOUBLE + l_tax * 5)::DOUBLE AS sigma, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS side FROM lineitem),
d1 AS (SELECT *, (ln(f / k) + sigma * sigma / 2 * t) / (sigma * sqrt(t)) AS a FROM te), d2 AS (SELECT *, a - sigma * sqrt(t) AS b, -a AS na, -(a - sigma * sqrt(t)) AS nb FROM d1)"""


@_query(f"""WITH {_TERMS} SELECT l_orderkey, l_linenumber, round(exp(-0.01::DOUBLE * t) * CASE WHEN side = 'C' THEN f * {_sql_cdf('a')} - k * {_sql_cdf('b')}
  ELSE k * {_sql_cdf('nb')} - f * {_sql_cdf('na')} END, 5) AS price FROM d2""")
def black76_price(spark, sf_dir):
    c = F.col
    return _terms(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(b76.black76_price(c("f"), c("k"), c("t"), F.lit(0.01), c("sigma"), c("side")), 5).alias("price"))


@_query(f"WITH {_TERMS} SELECT l_orderkey, l_linenumber, round(exp(-0.01::DOUBLE * t) * f * exp(-a * a / 2) / sqrt(2 * pi()) * sqrt(t), 5) AS vega FROM d1")
def black76_vega(spark, sf_dir):
    c = F.col
    return _terms(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(b76.black76_vega(c("f"), c("k"), c("t"), F.lit(0.01), c("sigma")), 5).alias("vega"))


@_query("""SELECT l_orderkey, l_linenumber, round(0.95::DOUBLE + l_discount, 9) AS moneyness, round(ln(0.95::DOUBLE + l_discount), 9) AS log_moneyness FROM lineitem""")
def moneyness(spark, sf_dir):
    c = F.col
    return _terms(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(b76.moneyness(c("k"), c("f")), 9).alias("moneyness"), F.round(b76.log_moneyness(c("k"), c("f")), 9).alias("log_moneyness"))


def _solver_input(spark, sf_dir) -> DataFrame:
    """Prices of known volatilities; by line number also some that are rejected (1), that fail (2) or are accepted near convergence (3).

    A volatility of 8 is beyond the bound of the Newton search, which stops at 5: with two years
    to expiry the price at 5 is within one percent, with half a year it is not.
    """
    c = F.col
    kind = c("l_linenumber")
    terms = _terms(spark, sf_dir).withColumns({"t": F.when(kind == 2, 0.5).when(kind == 3, 2.0).otherwise(c("t")), "sigma": F.when(kind.isin(2, 3), 8.0).otherwise(c("sigma"))})
    return terms.withColumn("price", F.when(kind == 1, -1.0).otherwise(b76.black76_price(c("f"), c("k"), c("t"), F.lit(0.01), c("sigma"), c("side"))))


def _solved(spark, sf_dir, solver) -> DataFrame:
    c = F.col
    return _solver_input(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(solver(c("price"), c("f"), c("k"), c("t"), F.lit(0.01), c("side")), 4).alias("implied_vol"))


def _solutions(spark, sf_dir) -> DataFrame:
    c = F.col
    x = b76.implied_volatility_solution(c("price"), c("f"), c("k"), c("t"), F.lit(0.01), c("side"))
    return _solver_input(spark, sf_dir).select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2) THEN NULL WHEN l_linenumber = 3 THEN 5.0 ELSE round(0.2::DOUBLE + l_tax * 5, 4) END AS implied_vol FROM lineitem")
def implied_vol_newton(spark, sf_dir):
    """Prices made from known volatilities, inverted; SQL gives the volatilities, or what the rules make of the row."""
    return _solved(spark, sf_dir, b76.black76_implied_volatility_vectorized)


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber IN (2, 3) THEN 8.0 ELSE round(0.2::DOUBLE + l_tax * 5, 4) END AS implied_vol FROM lineitem")
def implied_vol_bracketed(spark, sf_dir):
    """As above with the bracketed search, which reaches 10."""
    return _solved(spark, sf_dir, b76.black76_implied_volatility)


@_query("""
SELECT status, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) AS share, count(*) FILTER (status IN ('failed', 'accepted')) AS n_all_rounds
FROM (SELECT CASE l_linenumber WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' WHEN 3 THEN 'accepted' ELSE 'converged' END AS status FROM lineitem) GROUP BY 1""")
def solver_report(spark, sf_dir):
    return a.solver_report(_solutions(spark, sf_dir)).select("status", "n", "share", "n_all_rounds")


@_query("SELECT l_orderkey, l_linenumber, 5.0::DOUBLE AS final_vol, true AS hit_upper, false AS hit_lower FROM lineitem WHERE l_linenumber = 2 ORDER BY l_orderkey, l_linenumber LIMIT 3")
def failed_samples(spark, sf_dir):
    """The first three rows that the solver failed on (a report)."""
    return a.failed_samples(_solutions(spark, sf_dir), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round("final_vol", 9).alias("final_vol"), "hit_upper", "hit_lower")


@_query(f"""WITH {_TERMS} SELECT l_orderkey, l_linenumber, round(exp(-0.01::DOUBLE * t) * (f * {_sql_cdf('a')} - k * {_sql_cdf('b')}), 5) AS call,
  round(exp(-0.01::DOUBLE * t) * (k * {_sql_cdf('nb')} - f * {_sql_cdf('na')}), 5) AS put FROM d2""")
def black76_call_put(spark, sf_dir):
    terms = [F.col(x) for x in ("f", "k", "t")] + [F.lit(0.01), F.col("sigma")]
    return _terms(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(b76.black76_call_price(*terms), 5).alias("call"), F.round(b76.black76_put_price(*terms), 5).alias("put"))


def _quotes(spark, sf_dir, strikes) -> tuple[DataFrame, DataFrame]:
    """Option mids in coin with known volatility for every expiry in lineitem, and forwards, at the first day of 1995.

    ``strikes`` gives (share of the forward, volatility) from a number x, of which each expiry has several.
    """
    c = F.col
    t0 = 788918400000
    base = _t(spark, sf_dir, "lineitem").where("l_shipdate > TIMESTAMP_NTZ '1995-01-01'").groupBy("l_shipdate").agg(F.round(F.avg("l_extendedprice"), 0).alias("forward_price"))
    base = base.withColumn("expiry", c("l_shipdate").cast("timestamp") + F.expr("INTERVAL 8 HOURS"))
    forwards = base.select(F.lit(t0).alias("timestamp"), "expiry", "forward_price")
    xs, share, vol = strikes
    grid = base.withColumn("years", s.tenor_days(c("expiry"), F.lit(t0)) / 365.25).withColumn("x", F.explode(F.array(*[F.lit(x) for x in xs])))
    grid = grid.withColumns({"strike": F.round(c("forward_price") * share(c("x"), c("years")), 0), "vol": vol(c("x"))})
    coin = b76.black76_price(c("forward_price"), c("strike"), c("years"), F.lit(0.0), c("vol"), F.lit("C")) / c("forward_price")
    symbol = F.concat(F.lit("BTC-USD-"), F.date_format("l_shipdate", "yyMMdd"), F.lit("-"), c("strike").cast("bigint").cast("string"), F.lit("-C"))
    return grid.select(F.lit(t0).alias("timestamp"), symbol.alias("symbol"), coin.alias("mid_price")), forwards


#: Strikes by deviations of the expiry, so near the forward that the solver's plain Newton steps find every volatility.
_BY_DEVIATION = ((-0.5, -0.25, 0.0, 0.25, 0.5), lambda x, t: F.exp(x * F.sqrt(t) / 2), lambda x: F.lit(0.5) + F.abs(x) / 10)
#: The same shares of the forward for every expiry: far from it, prices of short expiries say nothing about the volatility.
_BY_SHARE = ((0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.25), lambda x, t: x, lambda x: F.lit(0.5) + F.pow(x - 1, F.lit(2.0)))


@_query("""
WITH f AS (SELECT l_shipdate, round(avg(l_extendedprice), 0) AS fp FROM lineitem WHERE l_shipdate > TIMESTAMP '1995-01-01' GROUP BY 1),
y AS (SELECT *, (epoch_us(l_shipdate + INTERVAL 8 HOUR) // 1000 - 788918400000) / 86400000.0::DOUBLE / 365.25::DOUBLE AS years FROM f),
g AS (SELECT *, unnest([-0.5::DOUBLE, -0.25, 0.0, 0.25, 0.5]) AS x FROM y)
SELECT 788918400000 AS timestamp, (l_shipdate + INTERVAL 8 HOUR) AS expiry, round(fp * exp(x * sqrt(years) / 2), 0)::BIGINT AS strike, 'C' AS option_type, fp AS forward_price,
  round(0.5::DOUBLE + abs(x) / 10, 4) AS implied_vol FROM g""")
def iv_points(spark, sf_dir):
    """IV of quotes of every expiry; SQL gives the volatilities that the prices were made from."""
    out = surface.compute_option_iv(*_quotes(spark, sf_dir, _BY_DEVIATION))
    return out.select("timestamp", F.col("expiry").cast("timestamp_ntz").alias("expiry"), "strike", "option_type", "forward_price", F.round("implied_vol", 4).alias("implied_vol"))


@_query("""
WITH p AS (SELECT ascii(l_returnflag)::BIGINT AS timestamp, l_discount::DOUBLE AS m, (year(l_shipdate) - 1994) * 365.25::DOUBLE AS t FROM lineitem GROUP BY ALL),
q AS (SELECT timestamp, quantile_cont(m, [0.05, 0.95]) AS m, quantile_cont(t, [0.05, 0.95]) AS t, min(m) AS m0, max(m) AS m1, min(t) AS t0, max(t) AS t1 FROM p GROUP BY 1),
b AS (SELECT timestamp, m0, m1, t0, t1, m[1] - 0.1::DOUBLE * (m[2] - m[1]) AS ml, m[2] + 0.1::DOUBLE * (m[2] - m[1]) AS mh,
  greatest(1e-6::DOUBLE, t[1] - 0.1::DOUBLE * (t[2] - t[1])) AS tl, t[2] + 0.1::DOUBLE * (t[2] - t[1]) AS th FROM q),
g AS (SELECT *, ml + (mh - ml) * j / 39 AS m, tl + (th - tl) * i / 39 AS t FROM b, (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j))
SELECT timestamp, i::INT AS i, j::INT AS j, round(m, 9) AS log_moneyness, round(t, 6) AS tenor_days,
  CASE WHEN m BETWEEN m0 AND m1 AND t BETWEEN t0 AND t1 THEN round(0.4::DOUBLE + 0.5 * m + 0.0002 * t, 6) END AS iv FROM g""")
def surface_grid(spark, sf_dir):
    """Grids over points of a plane on a full rectangle, where SQL knows the hull and the values; one time a return flag."""
    c = F.col
    cells = _t(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("bigint").alias("timestamp"), c("l_discount").cast("double").alias("log_moneyness"), ((F.year("l_shipdate") - 1994) * 365.25).alias("tenor_days")).distinct()
    out = surface.surface_grid(cells.withColumn("implied_vol", F.lit(0.4) + F.lit(0.5) * c("log_moneyness") + F.lit(0.0002) * c("tenor_days")))
    return out.select("timestamp", "i", "j", F.round("log_moneyness", 9).alias("log_moneyness"), F.round("tenor_days", 6).alias("tenor_days"), F.round("iv", 6).alias("iv"))


def _all_quotes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _quotes(spark, sf_dir, _BY_SHARE)


@_query()
def iv_points_every(spark, sf_dir):
    """As ``iv_points`` with wide strikes.  No SQL: where the price hardly depends on the volatility, the solution is not the known one to four digits."""
    out = surface.compute_option_iv(*_all_quotes(spark, sf_dir))
    return out.select("timestamp", F.col("expiry").cast("timestamp_ntz").alias("expiry"), "strike", "option_type", "forward_price", F.round("implied_vol", 4).alias("implied_vol"))


@_query()
def surface_grid_every(spark, sf_dir):
    return surface.surface_grid(surface.compute_option_iv(*_all_quotes(spark, sf_dir)))


_MONTHS = ("29MAR24", "28JUN24", "27SEP24")


def _trades(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Option trades and future prices with short symbols, from events; a mark is the price of a known volatility at _CENTER."""
    c = F.col
    e = _events(spark, sf_dir)
    month = F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), (c("user_id") % 3 + 1).cast("int"))
    forward = F.lit(42000.0) + c("user_id") % 3 * 500
    strike = (F.lit(36000) + c("user_id") % 7 * 2000).cast("bigint")
    side = F.when(c("user_id") % 2 == 0, "C").otherwise("P")
    options = e.where("event_id % 4 <> 0").withColumns({"month": month, "years": s.tenor_years(sym.short_expiry(month), F.lit(_CENTER)), "vol": F.lit(0.3) + c("event_id") % 50 / 100})
    price = b76.black76_price(forward, strike.cast("double"), c("years"), F.lit(0.0), c("vol"), side)
    options = options.select(F.concat(F.lit("BTC-"), c("month"), F.lit("-"), strike.cast("string"), F.lit("-"), side).alias("instrument_name"), c("ms").alias("timestamp"), price.alias("mark_price"), c("value").alias("amount"), F.when(c("user_id") % 2 == 0, "buy").otherwise("sell").alias("direction"))
    futures = e.where("event_id % 4 = 0").select(F.concat(F.lit("BTC-"), month).alias("instrument_name"), c("ms").alias("timestamp"), forward.alias("price"))
    return options.withColumn("price", c("mark_price")), futures


_MARKS = f"""{_E},
mo AS (SELECT unnest([0, 1, 2]) AS m, unnest(['29MAR24', '28JUN24', '27SEP24']) AS expiry, unnest([1711670400000, 1719532800000, 1727395200000]) AS due),
op AS (SELECT ms, value, expiry, 36000 + user_id % 7 * 2000 AS strike, CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'P' END AS option_type, due, 42000.0::DOUBLE + m * 500 AS forward_price, 0.3::DOUBLE + event_id % 50 / 100 AS vol
  FROM e JOIN mo ON user_id % 3 = m WHERE event_id % 4 <> 0),
fu AS (SELECT ms, expiry FROM e JOIN mo ON user_id % 3 = m WHERE event_id % 4 = 0),
ce AS (SELECT {_CENTER}::BIGINT AS c)"""
_YEAR_MS = "31557600000.0::DOUBLE"


@_query(f"""
WITH {_MARKS}, la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY expiry, strike, option_type ORDER BY ms DESC) AS r FROM op, ce WHERE ms BETWEEN c - {_LIMIT} AND c) WHERE r = 1),
lf AS (SELECT expiry, max(ms) AS fms FROM fu, ce WHERE ms BETWEEN c - {_LIMIT} AND c GROUP BY 1)
SELECT la.expiry, strike, option_type, forward_price, round(ln(strike / forward_price), 9) AS log_moneyness, round((due - c) / {_YEAR_MS}, 9) AS tenor_years, round(vol, 6) AS implied_vol,
  (c - ms) / 1000.0::DOUBLE AS mark_age_seconds, (c - fms) / 1000.0::DOUBLE AS future_age_seconds FROM la JOIN lf USING (expiry)""")
def iv_at_time(spark, sf_dir):
    """IV of every option at a time; SQL gives the volatility of its last mark."""
    out = surface.compute_iv_at_timestamp(*_trades(spark, sf_dir), _CENTER)
    return out.drop("mark_price").withColumns({"log_moneyness": F.round("log_moneyness", 9), "tenor_years": F.round("tenor_years", 9), "implied_vol": F.round("implied_vol", 6)})


@_query(f"""
WITH {_MARKS}, g AS (SELECT unnest(range(a, b + 21600000, 21600000)) AS ts FROM (SELECT min(ms) AS a, max(ms) AS b FROM op)),
x AS (SELECT ts, expiry, strike, option_type FROM g, (SELECT DISTINCT expiry, strike, option_type FROM op)),
o AS (SELECT x.*, op.ms, op.due, op.forward_price, op.vol FROM x ASOF JOIN op ON x.expiry = op.expiry AND x.strike = op.strike AND x.option_type = op.option_type AND x.ts >= op.ms WHERE x.ts - op.ms <= {_LIMIT}),
f AS (SELECT y.ts, y.expiry, fu.ms AS fms FROM (SELECT DISTINCT ts, expiry FROM x) y ASOF JOIN fu ON y.expiry = fu.expiry AND y.ts >= fu.ms WHERE y.ts - fu.ms <= {_LIMIT})
SELECT ts, o.expiry, strike, option_type, forward_price, round(ln(strike / forward_price), 9) AS log_moneyness, round((due - ts) / {_YEAR_MS}, 9) AS tenor_years,
  round(vol * sqrt((due - c)::DOUBLE / (due - ts)), 6) AS implied_vol, (ts - ms) / 1000.0::DOUBLE AS mark_age_seconds, (ts - fms) / 1000.0::DOUBLE AS future_age_seconds
FROM o JOIN f USING (ts, expiry), ce""")
def iv_timeseries(spark, sf_dir):
    """As above on a grid of times; with a rate of 0 a price fixes the volatility times the root of the tenor."""
    out = surface.prepare_iv_timeseries(*_trades(spark, sf_dir), time_step_minutes=360)
    return out.drop("mark_price").withColumns({"log_moneyness": F.round("log_moneyness", 9), "tenor_years": F.round("tenor_years", 9), "implied_vol": F.round("implied_vol", 6)})


@_query(f"""
WITH {_MARKS}, lf AS (SELECT expiry, max(ms) AS fms FROM fu, ce WHERE ms BETWEEN c - {_LIMIT} AND c GROUP BY 1)
SELECT op.expiry, strike, option_type, ms AS timestamp, value AS amount, CASE option_type WHEN 'C' THEN 'buy' ELSE 'sell' END AS direction, forward_price, round(vol, 6) AS implied_vol,
  (c - fms) / 1000.0::DOUBLE AS future_age_seconds, (ms - c) / 1000.0::DOUBLE AS time_offset FROM op JOIN lf USING (expiry), ce WHERE ms BETWEEN c - 36000000 AND c + 36000000""")
def trade_iv(spark, sf_dir):
    """IV of the trades within ten hours of a time, at their own prices."""
    options, futures = _trades(spark, sf_dir)
    out = surface.trade_iv(options, futures, _CENTER, window_minutes=600)
    return out.select("expiry", "strike", "option_type", "timestamp", "amount", "direction", "forward_price", F.round("implied_vol", 6).alias("implied_vol"), "future_age_seconds", "time_offset")


@_query("""
WITH o AS (SELECT event_id, 'BTC-' || ['29MAR24', '28JUN24', '27SEP24'][user_id % 3 + 1] || '-' || (36000 + user_id % 7 * 2000) || '-' || CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'P' END AS name FROM events)
SELECT event_id, string_split(name, '-')[3]::BIGINT AS strike, string_split(name, '-')[4] AS option_type FROM o WHERE starts_with(name, 'BTC-28JUN24-')""")
def trades_of_expiry(spark, sf_dir):
    """Strike and side of the trades in one expiry."""
    name = F.concat(F.lit("BTC-"), F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), (F.col("user_id") % 3 + 1).cast("int")), F.lit("-"), (F.lit(36000) + F.col("user_id") % 7 * 2000).cast("bigint").cast("string"), F.when(F.col("user_id") % 2 == 0, "-C").otherwise("-P"))
    return _t(spark, sf_dir, "events").select("event_id", sym.strike_and_side(name, "28JUN24").alias("p")).where("p IS NOT NULL").select("event_id", "p.*")


# ---- windows, fits ----


@_query("""
WITH h AS (SELECT event_type AS strike, date_trunc('hour', ts) AS hour, value FROM events),
g AS (SELECT strike, hour FROM (SELECT DISTINCT strike FROM h) CROSS JOIN (SELECT DISTINCT hour FROM h)),
c AS (SELECT g.strike, g.hour, coalesce(sum(value), 0) AS value FROM g LEFT JOIN h USING (strike, hour) GROUP BY ALL)
SELECT strike, hour, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY strike ORDER BY hour ROWS 2 PRECEDING), 6) AS rolling FROM c""")
def hourly_pivot_rolling3(spark, sf_dir):
    h = _t(spark, sf_dir, "events").select(F.col("event_type").alias("strike"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), F.col("value").alias("amount"))
    out = a.create_volume_pivot(h)
    return out.select("strike", "hour", F.round("value", 6).alias("value"), F.round("rolling", 6).alias("rolling"))


@_query("SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS index_price FROM events GROUP BY 1")
def hourly_index_mean(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.round(F.avg("value"), 6).alias("index_price"))


@_query("""
WITH k AS (SELECT DISTINCT l_quantity * 10 AS strike FROM lineitem)
SELECT event_id, value, (SELECT count(*) FROM k WHERE strike < value)::INT AS n_below, ((SELECT count(*) FROM k) - 1 - (SELECT count(*) FROM k WHERE strike < value))::INT AS y FROM events""")
def strike_rank_lookup(spark, sf_dir):
    strikes = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 10).alias("strike"))
    return a.strike_rank(_t(spark, sf_dir, "events").select("event_id", "value"), "value", strikes)


@_query("""
WITH o AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT l_suppkey, regr_slope(ln(y), x) AS sl, regr_intercept(ln(y), x) AS ic, avg(y) AS my, count(*) AS n FROM o GROUP BY 1)
SELECT l_suppkey, round(any_value(sl), 9) AS slope, round(any_value(ic), 9) AS intercept, any_value(n) AS n, round(1 - sum((y - exp(ic + sl * x)) ** 2) / sum((y - my) ** 2), 6) AS r2
FROM o JOIN f USING (l_suppkey) WHERE sl IS NOT NULL AND isfinite(sl) GROUP BY 1""")
def term_structure_fit(spark, sf_dir):
    o = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return a.loglinear_fit(o, "l_suppkey", "x", "y").select("l_suppkey", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"), "n", F.round("r2", 6).alias("r2"))


@_query("""
WITH o AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT g, regr_slope(ln(y), x) AS sl, regr_intercept(ln(y), x) AS ic, min(x) AS lo, max(x) AS hi FROM o GROUP BY 1)
SELECT g, i::INT AS i, round(x, 9) AS x, round(exp(ic + sl * x), 4) AS y FROM (SELECT *, lo + (hi - lo) * i / 99 AS x FROM (SELECT *, unnest(range(100)) AS i FROM f))""")
def fitted_curve(spark, sf_dir):
    o = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return a.fitted_curve(a.loglinear_fit(o, "g", "x", "y"), "g").select("g", "i", F.round("x", 9).alias("x"), F.round("y", 4).alias("y"))


@_query("""
WITH q AS (SELECT quantile_cont(l_extendedprice::DOUBLE, [0.01, 0.99]) AS x, min(l_quantity) AS t0, max(l_quantity) AS t1, quantile_cont(l_discount::DOUBLE, [0.01, 0.99]) AS z FROM lineitem)
SELECT round(x[1] - (x[2] - x[1]) * 0.05, 6) AS x_low, round(x[2] + (x[2] - x[1]) * 0.05, 6) AS x_high, round(greatest(0.1, t0 * 0.9), 6) AS y_low, round(t1 * 1.1, 6) AS y_high,
  round(greatest(0, z[1] - (z[2] - z[1]) * 0.05), 6) AS z_low, round(z[2] + (z[2] - z[1]) * 0.05, 6) AS z_high FROM q""")
def axis_bounds(spark, sf_dir):
    out = a.axis_bounds(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_query("SELECT round(min(l_extendedprice) * 0.95, 6) AS low, round(max(l_extendedprice) * 1.05, 6) AS high FROM lineitem")
def padded_range(spark, sf_dir):
    out = a.padded_range(_t(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 60)")
def groups_of_enough(spark, sf_dir):
    return a.enough(_t(spark, sf_dir, "events"), "user_id", 60).select("event_id", "user_id")


@_query("""
WITH q AS (SELECT quantile_cont(l_extendedprice::DOUBLE, [0.05, 0.95]) AS x, quantile_cont((l_quantity / 50)::DOUBLE, [0.05, 0.95]) AS t, quantile_cont(l_discount::DOUBLE, [0.05, 0.95]) AS z FROM lineitem)
SELECT round(x[1] - (x[2] - x[1]) * 0.1, 6) AS x_low, round(x[2] + (x[2] - x[1]) * 0.1, 6) AS x_high, round(greatest(0, z[1] - (z[2] - z[1]) * 0.1), 6) AS z_low, round(z[2] + (z[2] - z[1]) * 0.1, 6) AS z_high,
  round(log10(greatest(1 / 365.0::DOUBLE, t[1])), 6) AS log_t_low, round(log10(greatest(1 / 365.0::DOUBLE, t[2])), 6) AS log_t_high FROM q""")
def viewer_bounds(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").withColumn("years", F.col("l_quantity") / 50)
    out = a.viewer_bounds(df, "l_extendedprice", "years", "l_discount")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_query(f"""
WITH {_E} SELECT ms AS timestamp, value AS price FROM e WHERE user_id = 7 AND event_type = 'click' AND ms BETWEEN {_CENTER} - 864000000 AND {_CENTER} + 864000000""")
def price_points(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("strike"), F.lit("C").alias("option_type"), F.col("ms").alias("timestamp"), F.col("value").alias("price"), F.col("value").alias("mark_price"), F.when(F.col("event_type") == "click", "buy").otherwise("sell").alias("direction"))
    return plots.plot_prices(e, 7, "C", _CENTER - 864_000_000, _CENTER + 864_000_000)["buys"]


@_query("SELECT event_id, format('{:,.2f}', value * 1000) AS number, printf('%.2f%%', value) AS percent FROM events")
def number_labels(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", s.number_label(F.col("value") * 1000).alias("number"), s.percent_label(F.col("value") / 100, 2).alias("percent"))


@_query("""
WITH h AS (SELECT l_returnflag AS strike, date_trunc('month', l_shipdate) AS hour, l_quantity * l_extendedprice AS v FROM lineitem),
g AS (SELECT strike, hour FROM (SELECT DISTINCT strike FROM h) CROSS JOIN (SELECT DISTINCT hour FROM h)),
c AS (SELECT g.strike, g.hour, coalesce(sum(v), 0) AS value FROM g LEFT JOIN h USING (strike, hour) GROUP BY ALL)
SELECT strike, hour, round(value, 2) AS value, round(avg(value) OVER (PARTITION BY strike ORDER BY hour ROWS 2 PRECEDING), 3) AS rolling FROM c""")
def value_pivot_rolling3(spark, sf_dir):
    h = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("strike"), F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz").alias("hour"), F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("price"))
    out = a.create_value_pivot(h)
    return out.select("strike", "hour", F.round("value", 2).alias("value"), F.round("rolling", 3).alias("rolling"))


@_query("""
SELECT strike, round(coalesce(sum(v) FILTER (k = 0), 0), 4) AS "0", round(coalesce(sum(v) FILTER (k = 1), 0), 4) AS "1", round(coalesce(sum(v) FILTER (k = 2), 0), 4) AS "2"
FROM (SELECT event_type AS strike, user_id % 3 AS k, value AS v FROM events) GROUP BY 1""")
def wide_pivot(spark, sf_dir):
    cells = a.dense_cells(_t(spark, sf_dir, "events").select(F.col("event_type").alias("strike"), (F.col("user_id") % 3).alias("k"), "value"), "strike", "k", F.col("value"))
    out = a.wide(cells, "strike", "k", "value")
    return out.select("strike", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in out.columns if c != "strike"])


@_query("SELECT event_id, len(list_filter([10.0::DOUBLE, 50, 100, 200, 400], lambda v: v >= value / 2 AND v <= value))::INT AS n_ticks FROM events")
def axis_ticks(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.size(s.ticks_within([10.0, 50.0, 100.0, 200.0, 400.0], F.col("value") / 2, F.col("value"))).alias("n_ticks"))


@_query("""
SELECT (epoch_ms(d) - 28800000)::BIGINT AS begin_ms, (epoch_ms(least(d + INTERVAL 19 DAY, TIMESTAMP '2025-02-28')) + 86399000 - 28800000)::BIGINT AS end_ms
FROM (SELECT unnest(range(TIMESTAMP '2025-01-01', TIMESTAMP '2025-03-01', INTERVAL 20 DAY)) AS d)""")
def date_chunks(spark, sf_dir):
    return spark.createDataFrame(create_date_chunks(date(2025, 1, 1), date(2025, 3, 1), 1), "begin_ms bigint, end_ms bigint")


QUERIES |= archives.QUERIES | streams.QUERIES
ORACLE_SQL |= archives.ORACLE_SQL | streams.ORACLE_SQL
