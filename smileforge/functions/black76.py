"""Black-76 prices, vega and implied volatility.

Prices and vega are Column expressions and stay in generated code.  Root
solving needs loops that end row by row, so it runs in Arrow batches with
numpy: only rows that have not converged take part in a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rational approximation of the normal distribution function
# (Hart; West 2005, "Better approximations to cumulative normal functions").
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SQRT_2PI = math.sqrt(2 * math.pi)

NEWTON_ROUNDS, NEWTON_TOLERANCE = 100, 1e-6
NEWTON_BOUNDS, SEED_BOUNDS = (0.01, 5.0), (0.05, 2.0)
BRACKET = (0.01, 10.0)
INTRINSIC_SLACK = 0.99


def _horner(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = x * out + c
    return out


def norm_cdf(x: Column) -> Column:
    """Normal distribution function; the ratio has the right limit in the tails, so one form serves everywhere."""
    return _at(x, _cdf_of)


def _at(x: Column, f) -> Column:
    """``f`` of a value that is computed once, as the variable of a one-element fold, however often ``f`` uses it.

    Written out, the value would be repeated in every term of a polynomial, and
    the generated method would be too large to be compiled.
    """
    return F.aggregate(F.array(x), F.lit(None).cast("double"), lambda _, v: f(v))


def _cdf_of(x: Column) -> Column:
    a = F.abs(x)
    upper = F.exp(-x * x / 2) * _horner(a, _TOP) / _horner(a, _BOTTOM)
    return F.lit(0.5) + F.signum(x) * (F.lit(0.5) - upper)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / SQRT_2PI


def _d1(f: Column, k: Column, t: Column, sigma: Column) -> Column:
    return (F.ln(f / k) + sigma * sigma / 2 * t) / (sigma * F.sqrt(t))


def _live(t: Column, sigma: Column) -> Column:
    return (t > 0) & (sigma > 0)


def _discounted(f: Column, k: Column, t: Column, r: Column, sigma: Column, sign: Column) -> Column:
    """Price of a call (sign 1) or a put (-1)."""
    d1 = _d1(f, k, t, sigma)
    d2 = d1 - sigma * F.sqrt(t)
    term = lambda x, w: F.struct((sign * x).alias("x"), w.cast("double").alias("w"))
    value = F.aggregate(F.array(term(d1, f), term(d2, -k)), F.lit(0.0), lambda total, v: total + v["w"] * _cdf_of(v["x"]))
    return F.exp(-r * t) * sign * value


def black76_call_price(f: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    """Call price; without time or volatility the undiscounted intrinsic value."""
    return F.when(_live(t, sigma), _discounted(f, k, t, r, sigma, F.lit(1.0))).otherwise(F.greatest(f - k, F.lit(0.0)))


def black76_put_price(f: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    """Put price; without time or volatility the undiscounted intrinsic value."""
    return F.when(_live(t, sigma), _discounted(f, k, t, r, sigma, F.lit(-1.0))).otherwise(F.greatest(k - f, F.lit(0.0)))


def black76_price(f: Column, k: Column, t: Column, r: Column, sigma: Column, option_type: Column) -> Column:
    """Price by side; 0 for rows without a price and for sides other than C and P."""
    valid = (f > 0) & (k > 0) & _live(t, sigma) & option_type.isin("C", "P")
    return F.when(valid, _discounted(f, k, t, r, sigma, F.when(option_type == "C", 1.0).otherwise(-1.0))).otherwise(F.lit(0.0))


def black76_vega(f: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    """Price change per unit of volatility; 0 for rows without a price."""
    valid = (f > 0) & (k > 0) & _live(t, sigma)
    return F.when(valid, F.exp(-r * t) * f * norm_pdf(_d1(f, k, t, sigma)) * F.sqrt(t)).otherwise(F.lit(0.0))


def moneyness(k: Column, f: Column) -> Column:
    return F.when(f > 0, k / f)


def log_moneyness(k: Column, f: Column) -> Column:
    return F.when((f > 0) & (k > 0), F.ln(k / f))


# ---- numpy forms, for the solvers ----


def cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    with np.errstate(over="ignore", under="ignore"):
        upper = np.exp(-x * x / 2) * _horner(a, _TOP) / _horner(a, _BOTTOM)
    return np.where(x > 0, 1 - upper, upper)


def price_and_vega(f, k, t, r, sigma, call, put):
    root = sigma * np.sqrt(t)
    d1 = (np.log(f / k) + sigma * sigma / 2 * t) / root
    d2 = d1 - root
    discount = np.exp(-r * t)
    value = np.where(call, f * cdf(d1) - k * cdf(d2), np.where(put, k * cdf(-d2) - f * cdf(-d1), 0.0)) * discount
    return value, discount * f * np.exp(-d1 * d1 / 2) / SQRT_2PI * np.sqrt(t)


#: Outcomes of the solver.
STATUSES = ("converged", "accepted", "rejected", "failed")


def newton(price, f, k, t, r, side, rounds=NEWTON_ROUNDS, tolerance=NEWTON_TOLERANCE) -> pd.DataFrame:
    """Implied volatility by Newton steps.

    Rows need positive price, forward, strike and time and a price of 99 % of
    the discounted intrinsic value.  The start is the at-the-money
    approximation within [0.05, 2]; steps stay within [0.01, 5].  A row whose
    price is met to the tolerance keeps the volatility tested.  What has not
    converged is accepted if the price is met to 1 % and the volatility has
    moved by more than 0.02.  Also told are the rounds with hardly any vega, and
    whether a step went below or above the bounds.
    """
    price, f, k, t, r = (np.asarray(x, float) for x in (price, f, k, t, r))
    side = np.asarray(side, object)
    call, put = side == "C", side == "P"
    n = len(price)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        intrinsic = np.maximum(np.where(call, f - k, k - f), 0)
        valid = (price > 0) & (f > 0) & (k > 0) & (t > 0) & np.isfinite(price + f + k + t + r) & (price >= INTRINSIC_SLACK * np.exp(-r * t) * intrinsic)
        seed = np.clip(np.sqrt(2 * np.pi / np.where(t > 0, t, 1)) * price / np.where(f > 0, f, 1), *SEED_BOUNDS)
    sigma, steps = seed.copy(), np.zeros(n, np.int32)
    flat, low, high = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)
    status = np.full(n, 2, np.int8)
    active = np.flatnonzero(valid)
    for step in range(1, rounds + 1):
        if not len(active):
            break
        s = sigma[active]
        value, vega = price_and_vega(f[active], k[active], t[active], r[active], s, call[active], put[active])
        diff = value - price[active]
        steps[active] = step
        met = np.abs(diff) < tolerance
        status[active[met]] = 0
        flat[active] += vega <= 1e-10
        move = ~met & (vega > 1e-10)
        new = s[move] - diff[move] / vega[move]
        low[active[move]] |= new < NEWTON_BOUNDS[0]
        high[active[move]] |= new > NEWTON_BOUNDS[1]
        s[move] = np.clip(new, *NEWTON_BOUNDS)
        sigma[active] = s
        active = active[~met]
    error = np.full(n, np.nan)
    rows = np.flatnonzero(valid)
    value, _ = price_and_vega(f[rows], k[rows], t[rows], r[rows], sigma[rows], call[rows], put[rows])
    error[rows] = np.abs(value - price[rows]) / price[rows]
    near = (error[active] < 0.01) & (np.abs(sigma[active] - seed[active]) > 0.02)
    status[active] = np.where(near, 1, 3)
    vol = np.where(status <= 1, sigma, np.nan)
    return pd.DataFrame({"implied_vol": vol, "status": np.array(STATUSES, object)[status], "iterations": steps, "price_error": error, "low_vega_rounds": flat, "hit_lower": low, "hit_upper": high, "final_vol": np.where(valid, sigma, np.nan)})


def bracketed(price, f, k, t, r, side, rounds=100) -> np.ndarray:
    """Implied volatility by a bracketed search on [0.01, 10]; NaN without a bracket.

    The price grows with the volatility, so the root is the only one; steps are
    Newton's where they stay in the bracket, else halving.
    """
    price, f, k, t, r = (np.asarray(x, float) for x in (price, f, k, t, r))
    call = np.asarray(side, object) == "C"
    out = np.full(len(price), np.nan)
    with np.errstate(invalid="ignore"):
        intrinsic = np.maximum(np.where(call, f - k, k - f), 0)
        rows = np.flatnonzero((t > 0) & (f > 0) & (k > 0) & np.isfinite(price + r) & (price >= INTRINSIC_SLACK * np.exp(-r * t) * intrinsic))
    p, f, k, t, r, call = (x[rows] for x in (price, f, k, t, r, call))
    at = lambda s, i=slice(None): price_and_vega(f[i], k[i], t[i], r[i], s, call[i], ~call[i])
    low, high = np.full(len(rows), BRACKET[0]), np.full(len(rows), BRACKET[1])
    has = (at(low)[0] <= p) & (at(high)[0] >= p) if len(rows) else np.zeros(0, bool)
    sigma = np.sqrt(low * high)
    active = np.flatnonzero(has)
    for _ in range(rounds):
        if not len(active):
            break
        s = sigma[active]
        value, vega = at(s, active)
        above = value >= p[active]
        high[active[above]] = s[above]
        low[active[~above]] = s[~above]
        with np.errstate(divide="ignore", invalid="ignore"):
            new = s - (value - p[active]) / vega
        inside = (new > low[active]) & (new < high[active])
        new = np.where(inside, new, (low[active] + high[active]) / 2)
        sigma[active] = new
        active = active[np.abs(new - s) > 1e-13]
    out[rows[has]] = sigma[has]
    return out


_NEWTON_SCHEMA = T.StructType([T.StructField("implied_vol", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("iterations", T.IntegerType()), T.StructField("price_error", T.DoubleType()), T.StructField("low_vega_rounds", T.IntegerType()), T.StructField("hit_lower", T.BooleanType()), T.StructField("hit_upper", T.BooleanType()), T.StructField("final_vol", T.DoubleType())])


@F.pandas_udf(_NEWTON_SCHEMA)
def _newton_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        yield newton(*columns)


@F.pandas_udf(T.DoubleType())
def _bracketed_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series(bracketed(*columns))


def implied_volatility_solution(price: Column, f: Column, k: Column, t: Column, r: Column, option_type: Column) -> Column:
    """struct(implied_vol, status, iterations, price_error, low_vega_rounds, hit_lower, hit_upper, final_vol) by Newton steps."""
    return _newton_udf(price.cast("double"), f.cast("double"), k.cast("double"), t.cast("double"), r.cast("double"), option_type)


def black76_implied_volatility_vectorized(price: Column, f: Column, k: Column, t: Column, r: Column, option_type: Column) -> Column:
    """Implied volatility by Newton steps; null where there is none."""
    v = implied_volatility_solution(price, f, k, t, r, option_type)["implied_vol"]
    return F.nanvl(v, F.lit(None).cast("double"))


def black76_implied_volatility(price: Column, f: Column, k: Column, t: Column, r: Column, option_type: Column) -> Column:
    """Implied volatility by the bracketed search; null where there is none."""
    v = _bracketed_udf(price.cast("double"), f.cast("double"), k.cast("double"), t.cast("double"), r.cast("double"), option_type)
    return F.nanvl(v, F.lit(None).cast("double"))
