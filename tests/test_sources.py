import gzip
import json
import time
from datetime import date, datetime, timezone

import pytest

from smileforge.sources import archive, trades
from smileforge.sources.planner import create_date_chunks
from smileforge.streaming import live


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


def test_chunks():
    assert create_date_chunks(date(2025, 1, 1), date(2025, 1, 3), 6) == [(ms(2025, 1, 1), ms(2025, 1, 1, 23, 59, 59)), (ms(2025, 1, 2), ms(2025, 1, 2, 23, 59, 59))]
    assert len(create_date_chunks(date(2025, 1, 1), date(2025, 3, 1), 1)) == 3
    assert len(create_date_chunks(date(2024, 1, 1), date(2025, 6, 1), 1, "monthly")) == 2
    assert create_date_chunks(date(2025, 1, 1), date(2025, 1, 2), 1)[0][0] == ms(2024, 12, 31, 16)
    assert len(create_date_chunks(datetime(2025, 1, 1, 12), datetime(2025, 1, 1, 15), 6)) == 1  # an odd end stops too
    assert create_date_chunks(date(2025, 1, 1), date(2025, 1, 1), 6) == []


def test_fetch_futures_book(spark, tmp_path):
    day = tmp_path / "2025-01-10"
    day.mkdir()
    for name in ("BTC-USD-250131", "BTC-USDC-250131"):
        with gzip.open(day / f"{name}.csv.gz", "wt") as f:
            f.write("timeMs,askPx1,askSz1,askCnt1,bidPx1,bidSz1,bidCnt1\n1,11.0,1,1,9.0,1,1\n2,,1,1,9.0,1,1\n")
    out = archive.fetch_market_data(spark, str(tmp_path), 6, "FUTURES", ["BTC-USD"], date(2025, 1, 10), date(2025, 1, 11), depth=0, file_depth=1)
    assert [(r["symbol"], r["mid_price"]) for r in out.collect()] == [("BTC-USD-250131", 10.0)]
    both = archive.fetch_market_data(spark, str(tmp_path), 6, "FUTURES", "BTC", date(2025, 1, 10), date(2025, 1, 11), depth=0, file_depth=1, include_criterion=lambda n: "250131" in n, process_fn=lambda df: df.select("symbol"))
    assert both.distinct().count() == 2 and both.columns == ["symbol"]
    empty = archive.fetch_market_data(spark, str(tmp_path), 6, "FUTURES", "BTC-USD", date(2024, 1, 1), date(2024, 1, 2), depth=0, file_depth=1)
    assert empty.count() == 0 and "mid_price" in empty.columns


def test_index_decides_what_is_read(spark, tmp_path):
    """Only listed files of the family and of known expiries are opened."""
    from smileforge.sources.history import construct_iv_surface_from_archive, file_expiry

    t0 = ms(2025, 1, 10)
    coin = 0.08

    def put(name, text):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
        return {"filename": name, "url": str(tmp_path / name), "sizeMB": 1.5}

    quote = f"symbol,timeMs,exchTimeMs,ask_1_px,ask_1_sz,ask_1_ordcnt,bid_1_px,bid_1_sz,bid_1_ordcnt\n{{0}},{t0 + 5},{t0 + 5},{coin},1,1,{coin},1,1\n"
    future = f"timeMs,askPx1,askSz1,askCnt1,bidPx1,bidSz1,bidCnt1\n{t0 + 1},100010,1,1,99990,1,1\n"
    futures = [put("BTC-USD-250627.csv.gz", future), put("BTC-USDC-250627.csv.gz", "not a book")]
    options = [put(f"{n}.csv.gz", quote.format(n)) for n in ("BTC-USD-250627-100000-C", "BTC-USD-250627-101000-P")] + [put("BTC-USD-251226-100000-C.csv.gz", "not a book"), put("readme.csv.gz", "not a book")]
    put("BTC-USD-250627-99000-C.csv.gz", quote.format("BTC-USD-250627-99000-C"))  # not listed
    listers = {}
    for kind, files in (("f", futures), ("o", options)):
        (tmp_path / f"{kind}-{t0}.json").write_text(json.dumps({"code": "0", "msg": "", "data": [{"details": [{"groupDetails": files}]}]}))
        listers[kind] = archive.index_lister(spark, str(tmp_path / f"{kind}-{{begin}}.json"))
    assert archive.index_summary(archive.read_index(spark, str(tmp_path / f"o-{t0}.json"))).first().asDict() == {"files": 4, "megabytes": 6.0}
    assert listers["f"](1, 2) == []
    (tmp_path / "bad.json").write_text(json.dumps({"code": "50011", "msg": "busy", "data": []}))
    assert archive.index_lister(spark, str(tmp_path / "bad.json"))(1, 2) == []
    out = construct_iv_surface_from_archive(spark, str(tmp_path), "BTC-USD", date(2025, 1, 10), 2, file_depth=1, lister=listers["f"], options_lister=listers["o"])
    assert sorted(r["symbol"] for r in out.collect()) == ["BTC-USD-250627-100000-C", "BTC-USD-250627-101000-P"]
    assert file_expiry("BTC-USD-250627-1-C.OK") == datetime(2025, 6, 27, 8) and file_expiry("BTC-USD-250627") is None and file_expiry("a-b-c-d-e") is None


def test_index_and_pages(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"code": "0", "msg": "", "data": [{"details": [{"groupDetails": [{"filename": "a.csv.gz", "url": "u", "sizeMB": 1.0}]}]}]}))
    assert [r["filename"] for r in archive.read_index(spark, str(tmp_path / "index.json")).collect()] == ["a.csv.gz"]
    row = lambda i, t: {"trade_id": str(i), "timestamp": t, "instrument_name": "x", "price": 1.0}
    (tmp_path / "p1.json").write_text(json.dumps({"result": {"trades": [row(1, 1), row(2, 2)], "has_more": True}}))
    (tmp_path / "p2.json").write_text(json.dumps({"result": {"trades": [row(2, 2), row(3, 3)], "has_more": False}}))
    assert sorted(r["trade_id"] for r in trades.read_pages(spark, str(tmp_path / "p*.json")).collect()) == ["1", "2", "3"]
    (tmp_path / "i.json").write_text(json.dumps({"result": [{"instrument_name": "a", "expiration_timestamp": 5}]}))
    assert trades.read_instruments(spark, str(tmp_path / "i.json")).first()["expiration_timestamp"] == 5
    (tmp_path / "k.json").write_text(json.dumps({"result": [{"instrument_name": n, "expiration_timestamp": 5} for n in ("BTC-31OCT25", "BTC-31OCT25-1-C", "ETH-31OCT25")]}))
    names = lambda *a: sorted(r["instrument_name"] for r in trades.read_instruments(spark, str(tmp_path / "k.json"), *a).collect())
    assert names("BTC") == ["BTC-31OCT25", "BTC-31OCT25-1-C"] and names("BTC", "option") == ["BTC-31OCT25-1-C"] and names(None, "future") == ["BTC-31OCT25", "ETH-31OCT25"]


DATA = [{"trade_id": str(i), "timestamp": i // 3, "instrument_name": "x", "price": float(i)} for i in range(40)]


def page(key, start, end, count):
    rows = [r for r in DATA if r["timestamp"] >= start and (end is None or r["timestamp"] <= end)]
    return rows[:10], len(rows) > 10


def test_cursor():
    seen = {r["trade_id"] for r in trades.all_pages(page, "BTC", 0)}
    assert seen == {r["trade_id"] for r in DATA}
    stuck = lambda key, start, end, count: ([{"timestamp": 0}] * 3 if start == 0 else [], start == 0)
    assert len(list(trades.all_pages(stuck, "k", 0, count=3))) == 3


def test_module_scan(spark, tmp_path):
    (tmp_path / "c.csv").write_text("open_time,open,high,low,close,vol\n1,1,1,1,1,0\n2,1,1,1,1,5\n")
    df = archive.read_module(spark, 2, str(tmp_path / "c.csv"))
    assert df.where("vol <> 0").count() == 1
    archive.write_partitioned(df, str(tmp_path / "out"), "open_time")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("kind", ["last", "dedup", "sliding"])
def test_streams(spark, tmp_path, kind):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 60, 1.0), (1, "a", 60, 1.0), (2, "a", 120, 2.0), (3, "a", 100000, 3.0)], "id int, s string, sec long, v double").selectExpr("id", "s", "timestamp_seconds(sec) AS ts", "v").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id int, s string, ts timestamp, v double").parquet(str(src))
    out = {"last": lambda: live.last_quote(stream, "ts", "s", ["v"]), "dedup": lambda: live.dedup(stream, "ts", "id"), "sliding": lambda: live.sliding_mean(stream, "ts", "s", "v")}[kind]()
    q = out.writeStream.format("memory").queryName(f"q_{kind}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table(f"q_{kind}").collect()
    assert {"last": lambda: [r["v"] for r in rows] == [2.0], "dedup": lambda: sorted(r["id"] for r in rows) == [1, 2, 3], "sliding": lambda: len(rows) == 3}[kind](), (time.time(), rows)
