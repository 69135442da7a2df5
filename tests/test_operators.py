import bisect
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from smileforge import schemas
from smileforge.functions.black76 import price_and_vega
from smileforge.operators import analytics as a
from smileforge.operators import asof, orderbook, plots, surface


def test_standard_names_and_symbol(spark):
    raw = spark.createDataFrame([(1, 10.0, 1.0, 9.0)], "timeMs long, askPx1 double, askSz2 double, bidPx1 double")
    out = orderbook.standardize_orderbook_columns(raw, "BTC-USD-250131.csv.gz")
    assert out.columns == ["symbol", "timeMs", "ask_1_px", "ask_2_sz", "bid_1_px"] and out.first()["symbol"] == "BTC-USD-250131"
    assert orderbook.standardize_orderbook_columns(out, "x.csv.gz").columns == out.columns
    plain = spark.createDataFrame([(1,)], "timeMs long")
    assert orderbook.standardize_orderbook_columns(plain, "x.csv.gz").columns == ["timeMs"]


def test_trim(spark):
    df = spark.createDataFrame([("s", 1, 10.0, 9.0, 11.0), ("s", 2, None, 9.0, 11.0)], "symbol string, timeMs long, ask_1_px double, bid_1_px double, ask_2_px double")
    assert orderbook.trim_orderbook(df, 1).columns == ["symbol", "timeMs", "ask_1_px", "bid_1_px"]
    mid = orderbook.trim_orderbook(df, 0)
    assert mid.columns == ["symbol", "timeMs", "mid_price"] and [r["mid_price"] for r in mid.collect()] == [9.5]
    none = orderbook.trim_orderbook(df.drop("bid_1_px"), 0)
    assert none.columns == ["symbol", "timeMs", "mid_price"] and none.count() == 0


def test_bins_keep_last_and_first_of_ties(spark):
    rows = [("a", 1000, 1, 1.0), ("a", 1500, 2, 2.0), ("a", 1500, 3, 3.0), ("a", 2000, 4, 4.0), ("b", 1000, 5, 5.0)]
    out = orderbook.bin_orderbook(spark.createDataFrame(rows, "symbol string, timeMs long, seq int, px double"), "1s", order="seq")
    assert sorted((r["symbol"], r["timestamp"], r["seq"]) for r in out.collect()) == [("a", 1000, 2), ("a", 2000, 4), ("b", 1000, 5)]


def test_ties_go_to_the_first_row_read(spark, tmp_path):
    rows = [("a", 1500, "later", 3.0), ("a", 1500, "alpha", 2.0), ("b", 1000, None, 5.0)]
    spark.createDataFrame(rows, "symbol string, timeMs long, note string, px double").coalesce(1).write.parquet(str(tmp_path / "q"))
    out = orderbook.bin_orderbook(spark.read.parquet(str(tmp_path / "q")), "1s")
    assert sorted((r["symbol"], r["px"]) for r in out.collect()) == [("a", 3.0), ("b", 5.0)]
    by_text = orderbook.bin_orderbook(spark.read.parquet(str(tmp_path / "q")), "1s", order="note")  # any type orders ties
    assert sorted((r["symbol"], r["px"]) for r in by_text.collect()) == [("a", 2.0), ("b", 5.0)]


@pytest.mark.parametrize("small", [50_000, 3])
def test_exact_quantiles(spark, monkeypatch, small):
    """Refined histograms give what a sort gives, with many ties, huge values and hardly any spread."""
    monkeypatch.setattr(a, "SMALL_BUCKET", small)
    monkeypatch.setattr(a, "BUCKETS", 7)
    rng = random.Random(8)
    x = [rng.choice([0.0, 1.0, rng.random(), 1e9 * rng.random(), 1 + 1e-12 * rng.random()]) for _ in range(400)]
    df = spark.createDataFrame([(v, 5.0, None) for v in x] + [(None, 5.0, None), (float("nan"), 5.0, None)], "x double, same double, none double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.501, 0.99, 1.0]
    got = a.exact_quantiles(df, {"x": shares, "same": [0.3], "none": [0.5]})
    assert got["x"] == pytest.approx(list(np.quantile(x, shares)), rel=1e-12) and got["same"] == [5.0] and got["none"] == [None]
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), *[(float(k),) for k in range(20)]], "x double")
    assert a.exact_quantiles(ends, {"x": [0.0, 0.5, 1.0]})["x"] == [float("-inf"), 9.5, float("inf")]
    times = spark.createDataFrame([(t,) for t in [5, 5, 1, 9, 7, None]], "t long")
    assert a.middle_time(times, "t").first()["middle"] == 7 and a.middle_time(times.where("false"), "t").count() == 0


def test_grid_equals_slow_model(spark):
    rng = random.Random(13)
    rows = [(rng.choice("ab"), rng.randrange(1000), rng.choice([None, rng.random()])) for _ in range(80)]
    step, limit = 50, 120
    times = [t for _, t, _ in rows]
    grid = list(range(min(times), max(times) + step, step))
    want = {}
    for k in "ab":
        for g in grid:
            mine = [(t, v) for kk, t, v in rows if kk == k and g - limit <= t <= g]
            if mine:
                values = [(t, v) for t, v in mine if v is not None]
                newest = max(t for t, _ in values) if values else None
                want[k, g] = (max(t for t, _ in mine), {v for t, v in values if t == newest} or {None})
    got = {(r["k"], r["t"]): r for r in asof.asof_grid(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", ["v"], step, limit).collect()}
    assert got.keys() == want.keys()
    assert all(got[x]["t_right"] == want[x][0] and got[x]["v"] in want[x][1] and got[x]["age_seconds"] == (x[1] - want[x][0]) / 1000 for x in want)
    assert asof.asof_grid(spark.createDataFrame([], "k string, t long, v double"), ["k"], "t", ["v"], step, limit).count() == 0


def test_summaries(spark):
    df = spark.createDataFrame([(1, "ab"), (1, None), (None, "c"), (None, None)], "k int, s string")
    assert a.largest_group(df, ["k"]).first()["n"] == 2
    assert a.dropped_duplicates(df, "k").first().asDict() == {"rows": 4, "kept": 2, "dropped": 2}
    assert a.size_summary(df).first().asDict() == {"rows": 4, "columns": 2, "bytes": 11}
    assert a.size_summary(df.where("false")).first()["bytes"] == 0 and a.dropped_duplicates(df.where("false"), "k").first()["rows"] == 0


def test_combos(spark):
    df = spark.createDataFrame([("BTC-USD-250627-200000-C",), ("BTC-USD-250627-200000-P",), ("junk",)], "symbol string")
    assert [tuple(r) for r in orderbook.get_option_combos(df).collect()] == [(datetime(2025, 6, 27, 8), 200000)]


@pytest.mark.parametrize("bucket", [None, 50])
def test_asof_join_equals_slow_model(spark, bucket):
    rng = random.Random(1)
    right = sorted((rng.choice("ab"), rng.randrange(200), rng.choice([None, rng.random()])) for _ in range(60))
    left = [(rng.choice("abc"), rng.randrange(220)) for _ in range(50)]
    limit = 30
    out = asof.asof_join(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, v double"), ["k"], "t", ["v"], limit, bucket_ms=bucket)

    def slow(k, t):
        mine = [(x, v) for kk, x, v in right if kk == k and t - limit <= x <= t]
        last = max((x for x, _ in mine), default=None)
        values = [(x, v) for x, v in mine if v is not None]
        return last, max(values)[0] if values else None

    by_time = {}
    for k, x, v in right:
        if v is not None:
            by_time.setdefault((k, x), set()).add(v)
    got = out.collect()
    assert len(got) == len(left)
    for r in got:
        last, at = slow(r["k"], r["t"])
        assert r["t_right"] == last
        assert r["v"] is None if at is None else r["v"] in by_time[(r["k"], at)]


def test_latest_at_limits(spark):
    rows = [("f", 1000, 1.0), ("f", 2000, None), ("g", 0, 3.0), ("h", 3001, 4.0)]
    df = spark.createDataFrame(rows, "instrument_name string, timestamp long, price double")
    out = {r["instrument_name"]: (r["price"], r["age_seconds"]) for r in asof.latest_at(df, 3000, ["instrument_name"], "timestamp", ["price"], 2999).collect()}
    assert out == {"f": (1.0, 1.0)}


def test_windows_around(spark):
    t = spark.createDataFrame([(i * 10,) for i in range(100)], "timestamp long")
    c = spark.createDataFrame([(50,), (55,), (990,)], "center long")
    got = sorted((r["center"], r["timestamp"]) for r in asof.windows_around(t, c, 15).collect())
    assert got == sorted((c, x) for c in (50, 55, 990) for x in range(0, 1000, 10) if abs(x - c) <= 15)


def test_windows_around_come_by_time(spark):
    """Copies of a trade have the same rows one after the other, so that a file holds them once."""
    rng = np.random.default_rng(5)
    times = [int(x) for x in rng.integers(-40_000, 40_000, 160)]
    rows = [(i, x) for i, x in enumerate(times * 25)] + [(-1, None)]
    t = spark.createDataFrame(rows, "id long, timestamp long").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = asof.windows_around(t, t.select(F.col("timestamp").alias("center")), 5_000).select("id", "timestamp", "center", F.spark_partition_id().alias("p"))
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    near = {x: sorted(c for c in times for _ in range(25) if abs(c - x) <= 5_000) for x in set(times)}
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append(r["center"])
    assert by_id == {i: near[x] for i, x in rows[:-1]}
    order = [(r["p"], r["timestamp"] // 10_000, r["timestamp"]) for r in got]
    assert all(a[:2] != b[:2] or a <= b for a, b in zip(order, order[1:], strict=False))


def test_windows_around_has_small_partitions(spark, monkeypatch):
    """A partition has few enough trades for a file's dictionaries: small ones are not merged."""
    monkeypatch.setattr(asof, "PIECE", 100, raising=False)
    times = [i * 10_000 for i in range(-50, 50)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(times * 25)], "id long, timestamp long")
    got = asof.windows_around(t, t.select(F.col("timestamp").alias("center")), 5_000).select("id", "center", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["id"], r["center"]) for r in got) == sorted((i, x) for i, x in enumerate(times * 25) for _ in range(25))
    ids = {}
    for r in got:
        ids.setdefault(r["p"], set()).add(r["id"])
    assert len(ids) > 10 and max(map(len, ids.values())) <= 400
    none = t.where("id < 0")
    assert asof.windows_around(none, none.select(F.col("timestamp").alias("center")), 5_000).isEmpty()


def test_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x")], "v double, s string")
    assert {r["column"]: (r["nulls"], r["share"]) for r in a.profile(df).collect()} == {"v": (1, 0.5), "s": (1, 0.5)}


def test_wide_and_rank(spark):
    df = spark.createDataFrame([(1.0, "h1", 2.0, 3.0), (1.0, "h2", 4.0, 1.0), (2.0, "h2", 6.0, 1.0)], "strike double, hour string, amount double, price double")
    assert {r["strike"]: (r["h1"], r["h2"]) for r in a.wide(a.create_volume_pivot(df), "strike", "hour").collect()} == {1.0: (2.0, 3.0), 2.0: (0.0, 3.0)}
    assert {(r["strike"], r["hour"]): r["rolling"] for r in a.create_value_pivot(df).collect()}[(1.0, "h2")] == 5.0
    p = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (9.0,)], "px double")
    assert [r["n_below"] for r in a.strike_rank(p, "px", df).orderBy("px").collect()] == [bisect.bisect_left([1.0, 2.0], x) for x in (0.5, 1.0, 1.5, 9.0)]


def clouds():
    rng = np.random.default_rng(3)
    grid = np.array([(a, b) for a in range(7) for b in range(7)], float)
    rows = np.column_stack([rng.random(60), rng.integers(0, 4, 60) * 90.0])
    circle = np.array([(np.cos(a), np.sin(a)) for a in np.arange(30) / 30 * 2 * np.pi])
    return [rng.random((60, 2)), rng.random((60, 2)) * [1, 365], grid, grid * [0.02, 30], np.unique(rows, axis=0), circle, rng.random((3, 2))]


@pytest.mark.parametrize("p", clouds())
def test_triangulation_is_delaunay(p):
    t = surface.delaunay(p)
    assert set(t.ravel()) == set(range(len(p)))
    for tri in t:
        x, y, z = p[tri]
        m = 2 * np.array([y - x, z - x])
        c = np.linalg.solve(m, np.array([(y * y).sum() - (x * x).sum(), (z * z).sum() - (x * x).sum()]))
        square = ((x - c) ** 2).sum()
        assert (((p - c) ** 2).sum(axis=1) >= square * (1 - 1e-9)).all()
    edges, count = np.unique(np.sort(np.vstack([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1), axis=0, return_counts=True)
    for a, b in edges[count == 1]:  # an edge of one triangle has all points on one side
        u = p[b] - p[a]
        side = (u[0] * (p[:, 1] - p[a, 1]) - u[1] * (p[:, 0] - p[a, 0])) / np.hypot(*u)
        assert side.min() > -1e-9 or side.max() < 1e-9
    assert not len(surface.delaunay(np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float)))


def curved(p):
    return np.sin(5 * p[:, 0]) + np.cos(p[:, 1] / 3)


def test_gradients_bend_edges_least():
    p = np.random.default_rng(5).random((40, 2)) * [1, 30]
    t = surface.delaunay(p)
    a, b = np.zeros((80, 80)), np.zeros(80)
    for i, j in {tuple(sorted((x, y))) for tri in t for x in tri for y in tri if x != y}:
        for x, y in ((i, j), (j, i)):
            e, h = p[y] - p[x], np.hypot(*(p[y] - p[x])) ** 3
            a[2 * x : 2 * x + 2, 2 * x : 2 * x + 2] += 4 * np.outer(e, e) / h
            a[2 * x : 2 * x + 2, 2 * y : 2 * y + 2] += 2 * np.outer(e, e) / h
            b[2 * x : 2 * x + 2] += 6 * (curved(p)[y] - curved(p)[x]) * e / h
    assert np.abs(surface._gradients(p, curved(p), t).ravel() - np.linalg.solve(a, b)).max() < 1e-8


def test_cubic_element():
    rng = np.random.default_rng(6)
    p = rng.random((40, 2)) * [1, 30]
    t = surface.delaunay(p)
    across = surface._across(p, t)
    x, y = p.T
    square, slope = 1 + 2 * x - y + 3 * x * x - 0.5 * x * y + 0.1 * y * y, np.column_stack([2 + 6 * x - 0.5 * y, -1 - 0.5 * x + 0.2 * y])
    at = rng.random((500, 2)) * [1, 30]
    owner, w = surface._locate(p, t, at)
    ok = owner >= 0
    u, v = at[ok].T
    z = surface._clough_tocher(p, square, slope, t[owner[ok]], across[owner[ok]], w[ok])
    assert np.abs(z - (1 + 2 * u - v + 3 * u * u - 0.5 * u * v + 0.1 * v * v)).max() < 1e-9  # squares come back

    f = curved(p)
    g = surface._gradients(p, f, t)

    def value(k, at):
        weights = np.linalg.solve(np.vstack([p[t[k]].T, np.ones(3)]), np.append(at, 1))
        return surface._clough_tocher(p, f, g, t[[k]], across[[k]], weights[None])[0]

    sides = {}
    for k, tri in enumerate(t):
        for i in range(3):
            sides.setdefault(tuple(sorted((tri[i], tri[i - 1]))), []).append(k)
    for (i, j), both in sides.items():
        if len(both) < 2:
            continue
        middle = 0.3 * p[i] + 0.7 * p[j]
        assert abs(value(both[0], middle) - value(both[1], middle)) < 1e-9
        for step in ([1e-5, 0], [0, 3e-4]):
            slopes = [(value(k, middle + step) - value(k, middle - step)) / (2 * sum(step)) for k in both]
            assert abs(slopes[0] - slopes[1]) < 1e-3 * (1 + abs(slopes[0]))  # the same from both sides


@pytest.mark.parametrize("cubic", [False, True])
def test_interpolation(cubic):
    rng = np.random.default_rng(4)
    p = rng.random((50, 2)) * [1, 300]
    plane = 2 + 3 * p[:, 0] - 0.01 * p[:, 1]
    at = rng.random((200, 2)) * [1, 300]
    z = surface.interpolate(p, plane, at, cubic)
    ok = ~np.isnan(z)
    assert ok.sum() > 100 and np.abs(z[ok] - (2 + 3 * at[ok, 0] - 0.01 * at[ok, 1])).max() < 1e-6
    assert np.abs(surface.interpolate(p, np.sin(p[:, 0]), p, cubic) - np.sin(p[:, 0])).max() < 1e-9
    assert np.isnan(surface.interpolate(p, plane, np.array([[5.0, 5.0]]), cubic)).all()
    line = np.array([[0, 0], [1, 1], [2, 2]], float)
    assert np.isnan(surface.interpolate(line, np.ones(3), at, cubic)).all()


def test_surface_end_to_end(spark):
    t0 = 1735689600000
    rows = []
    for days, expiry in ((31, "250201"), (59, "250301"), (90, "250401")):
        years = (days + 8 / 24) / 365.25
        for k in range(90000, 116000, 5000):
            p, _ = price_and_vega(np.array([1e5]), np.array([float(k)]), np.array([years]), np.array([0.0]), np.array([0.6]), np.array([True]), np.array([False]))
            coin = float(p[0] / 1e5)
            rows += [(f"BTC-USD-{expiry}-{k}-C", t0 + 1000, coin * 1.01, coin * 0.99), (f"BTC-USD-{expiry}-{k}-C", t0 + 2000, None, coin)]
    options = spark.createDataFrame(rows, "symbol string, timeMs long, ask_1_px double, bid_1_px double")
    futures = spark.createDataFrame([(f"BTC-USD-{e}", t0 + 500, 100001.0, 99999.0) for e in ("250201", "250301", "250401")], "symbol string, timeMs long, ask_1_px double, bid_1_px double")
    iv = surface.construct_iv_surface(options, futures, "1min").cache()
    assert iv.columns == list(surface.IV_COLUMNS) and iv.count() == 18
    assert iv.select(F.max(F.abs(F.col("implied_vol") - 0.6))).first()[0] < 1e-4
    grid = surface.surface_grid(iv, 10)
    assert grid.count() == 100 and grid.where("iv IS NOT NULL").select(F.max(F.abs(F.col("iv") - 0.6))).first()[0] < 1e-3
    assert surface.surface_grid(iv.limit(2), 10).count() == 0
    plot = plots.create_iv_surface_plot(iv, 5)
    assert plot["frames"].count() == 25 and plot["axes"]["z_low"] >= 0


def test_trade_surface(spark):
    f = spark.createDataFrame([("BTC-31OCT25", 1000, 110000.0)], "instrument_name string, timestamp long, price double")
    o = spark.createDataFrame([("BTC-31OCT25-120000-C", 2000, 0.05, 0.05, 1.0, "buy"), ("BTC-PERPETUAL", 2000, 0.05, 0.05, 1.0, "buy"), ("BTC-1NOV25-120000-C", 2000, 0.05, 0.05, 1.0, "sell")], "instrument_name string, timestamp long, mark_price double, price double, amount double, direction string")
    at = 1759276800000
    shift = lambda df: df.withColumn("timestamp", F.col("timestamp") + at)
    iv = surface.compute_iv_at_timestamp(shift(o), shift(f), at + 3000, coin_price=True).collect()
    assert len(iv) == 1 and iv[0]["mark_age_seconds"] == 1.0 and iv[0]["future_age_seconds"] == 2.0 and 0.01 < iv[0]["implied_vol"] < 5
    series = surface.prepare_iv_timeseries(shift(o), shift(f), 5, coin_price=True).collect()
    assert [r["ts"] for r in series] == [at + 2000]
    trades = surface.trade_iv(shift(o), shift(f), at + 3000, coin_price=True)
    view = plots.create_iv_surface_viewer(surface.prepare_iv_timeseries(shift(o), shift(f), 5, coin_price=True), trades)
    assert view["trades"]["points"].first()["colour"] == "green" and view["calls"]["surface"]["points"].count() == 1


def test_schema_of_book():
    assert len(schemas.book(50).fields) == 3 + 300 and len(schemas.raw_futures_book(2).fields) == 13


def test_join_on_a_parsed_key(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None), (4, "b", 2), (5, "b", 2)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 1, 10.0), (None, 1, 20.0), ("b", None, 30.0), ("b", 2, 40.0), ("b", 2, 50.0)], "k string, t int, v double")
    got = surface.join_parsed(left, right, "k", ["t"])
    assert sorted(map(tuple, got.select("id", "k", "t", "v").collect())) == sorted(map(tuple, left.join(right, ["t", "k"]).select("id", "k", "t", "v").collect()))
    assert got.columns == ["id", "k", "t", "v"] and surface.join_parsed(left.select("id", "k"), right.drop("t").where("false"), "k").count() == 0
