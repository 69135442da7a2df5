import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from smileforge.functions import black76 as b
from smileforge.functions import scalars as s
from smileforge.functions import symbols as y


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_symbols(spark):
    r = one(spark, y.parse_option_name(F.lit("BTC-USD-250627-200000-c.OK")), y.parse_future_name(F.lit("BTC-USD-250131.OK")), y.parse_option_instrument(F.lit("BTC-31OCT25-120000-C")), y.parse_option_instrument(F.lit("BTC-31OCT25")), y.parse_option_name(F.lit("BTC-USD-250131")))
    assert r[0].asDict() == {"family": "BTC-USD", "expiry": datetime(2025, 6, 27, 8), "strike": 200000, "option_type": "C"}
    assert r[1].asDict() == {"family": "BTC-USD", "expiry": datetime(2025, 1, 31, 8)}
    assert (r[2]["expiry"], r[2]["strike"], r[2]["option_type"]) == ("31OCT25", 120000, "C")
    assert r[3] is None and r[4] is None


def test_strict_symbol_raises(spark):
    with pytest.raises(PySparkException):
        one(spark, y.parse_option_name(F.lit("BTC-USD-250131"), strict=True))


def test_short_expiry_and_regex(spark):
    r = one(spark, y.short_expiry(F.lit("1NOV25")), y.short_expiry(F.lit("31OCT25")), y.short_expiry(F.lit("PERP")), y.regex_symbol(F.lit("BTC-PERPETUAL")))
    assert r[0] == datetime(2025, 11, 1) and r[1] == datetime(2025, 10, 31) and r[2] is None and r[3]["strike"] is None


def test_scalars(spark):
    r = one(spark, s.fee_share(F.lit(0.0)), s.fee_share(F.lit(0.05)), s.clip(F.lit(7.0), 0, 5), s.clip(F.lit(None).cast("double"), 0, 5), s.linspace(F.lit(0.0), F.lit(1.0), 5), s.floor_ms(F.lit(-1), 1000), s.ticks_within([1, 5, 9], F.lit(2), F.lit(9)), s.lookup(F.lit("x"), {"a": "b"}, "z"))
    assert r[0] is None and r[1] == pytest.approx(0.6) and r[2] == 5 and r[3] is None
    assert list(r[4]) == [0, 0.25, 0.5, 0.75, 1] and r[5] == -1000 and list(r[6]) == [5, 9] and r[7] == "z"
    assert s.freq_ms("5min") == 300000 and s.freq_ms("100ms") == 100 and s.freq_ms("30s") == 30000
    with pytest.raises(ValueError):
        s.freq_ms("soon")


def test_cdf_matches_erfc():
    x = np.linspace(-12, 12, 4001)
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(b.cdf(x) - exact).max() < 1e-12


def test_prices_without_time(spark):
    z = F.lit(0.0)
    r = one(spark, b.black76_call_price(F.lit(110.0), F.lit(100.0), z, z, F.lit(0.5)), b.black76_put_price(F.lit(90.0), F.lit(100.0), F.lit(1.0), z, z), b.black76_price(F.lit(110.0), F.lit(100.0), z, z, F.lit(0.5), F.lit("C")), b.black76_price(F.lit(110.0), F.lit(100.0), F.lit(1.0), z, F.lit(0.5), F.lit("X")), b.black76_vega(F.lit(1.0), F.lit(1.0), z, z, F.lit(1.0)))
    assert tuple(r) == (10.0, 10.0, 0.0, 0.0, 0.0)


def test_parity_in_spark(spark):
    df = spark.createDataFrame([(100.0, k, t, 0.03, v) for k in (50.0, 100.0, 170.0) for t in (0.1, 2.0) for v in (0.1, 1.5)], "f double, k double, t double, r double, v double")
    c = [F.col(x) for x in "fktrv"]
    gap = b.black76_call_price(*c) - b.black76_put_price(*c) - F.exp(-F.col("r") * F.col("t")) * (F.col("f") - F.col("k"))
    assert df.select(F.max(F.abs(gap))).first()[0] < 1e-10


@settings(max_examples=60, deadline=None)
@given(st.floats(0.1, 2.0), st.floats(0.8, 1.25), st.floats(0.1, 2.0), st.sampled_from("CP"))
def test_round_trip(sigma, m, t, side):
    f, k = np.array([1000.0]), np.array([1000.0 * m])
    call = np.array([side == "C"])
    p, vega = b.price_and_vega(f, k, np.array([t]), np.array([0.0]), np.array([sigma]), call, ~call)
    if vega[0] < 5:
        return
    assert b.bracketed(p, f, k, [t], [0.0], [side])[0] == pytest.approx(sigma, abs=1e-6)
    r = b.newton(p, f, k, [t], [0.0], [side])
    if r.status[0] == "converged":
        assert r.implied_vol[0] == pytest.approx(sigma, abs=1e-5)


def test_solver_rejects():
    price = [0.0, np.nan, 5.0, 9.95, 10.0]
    r = b.newton(price, [110.0] * 5, [100.0] * 5, [1.0, 1.0, 1.0, 1.0, 0.0], [0.0] * 5, ["C"] * 5)
    assert list(r.status) == ["rejected", "rejected", "rejected", "failed", "rejected"] or r.status[3] in ("failed", "accepted")
    assert np.isnan(b.bracketed(price, [110.0] * 5, [100.0] * 5, [1.0] * 5, [0.0] * 5, ["C"] * 5)[[0, 1, 2, 3]]).all()
    assert len(b.newton([], [], [], [], [], [])) == 0 and len(b.bracketed([], [], [], [], [], [])) == 0


def test_solver_bounds():
    f = np.array([100.0])
    p, _ = b.price_and_vega(f, f, np.array([1.0]), np.array([0.0]), np.array([8.0]), np.array([True]), np.array([False]))
    assert b.bracketed(p, f, f, [1.0], [0.0], ["C"])[0] == pytest.approx(8.0, rel=1e-3)
    assert not b.newton(p, f, f, [1.0], [0.0], ["C"]).implied_vol[0] > 5


def test_strike_and_side(spark):
    names = ["BTC-31OCT25-120000-C", "BTC-1NOV25-5-P", "BTC-31OCT25", "ETH-31OCT25-1-C", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(y.strike_and_side(F.col("n"), "31OCT25").alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in rows] == [(120000, "C"), None, None, None, None]


def test_solver_tells_why():
    f = np.full(3, 100.0)
    p, _ = b.price_and_vega(f, f, np.array([0.5, 2.0, 1.0]), np.zeros(3), np.array([8.0, 8.0, 0.4]), np.array([True] * 3), np.array([False] * 3))
    r = b.newton(p, f, f, [0.5, 2.0, 1.0], [0.0] * 3, ["C"] * 3)
    assert list(r.status) == ["failed", "accepted", "converged"] and list(r.hit_upper) == [True, True, False] and list(r.iterations[:2]) == [100, 100]
    assert r.final_vol[0] == 5.0 and np.isnan(r.implied_vol[0]) and not r.hit_lower.any() and not r.low_vega_rounds.any()
