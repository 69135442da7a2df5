"""Implied-volatility points and surfaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.black76 import black76_implied_volatility, implied_volatility_solution, log_moneyness
from ..functions.scalars import finite, tenor_days, tenor_years
from ..functions.symbols import parse_option_instrument, parse_option_name, short_expiry
from .asof import asof_grid, grid_ends, latest_at
from .orderbook import bin_orderbook, forward_curve, standardize_orderbook_columns, trim_orderbook, with_known_expiry

IV_COLUMNS = ("timestamp", "symbol", "expiry", "strike", "option_type", "mid_price", "forward_price", "tenor_days", "log_moneyness", "implied_vol")


def join_parsed(left: DataFrame, right: DataFrame, parsed: str, on: list[str] | None = None) -> DataFrame:
    """Inner join on ``on`` and on ``parsed``, a column of ``left`` that is costly to compute.

    The equality is null-safe and ``right`` without nulls, so the rows are those of
    a plain join; that would put a not-null filter on the scan, which parses every row once more.
    """
    keys = [*(on or []), parsed]
    side = right.where(F.col(parsed).isNotNull()).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k == parsed else F.col(k) == F.col(f"__{k}") for k in keys]
    return left.join(side, same, "inner").drop(*(f"__{k}" for k in keys))


def _priced(options: DataFrame, forwards: DataFrame) -> DataFrame:
    """Options with symbol fields, forward, tenor and price in USD; rows without a positive tenor, strike or forward are dropped."""
    p = parse_option_name(F.col("symbol"))
    o = options.select("timestamp", "symbol", F.col("mid_price").alias("coin_price"), p.alias("p")).select("timestamp", "symbol", "coin_price", "p.expiry", "p.strike", "p.option_type")
    joined = join_parsed(o, forwards, "expiry", ["timestamp"])
    out = joined.withColumn("tenor_days", tenor_days(F.col("expiry"), F.col("timestamp"))).withColumn("log_moneyness", log_moneyness(F.col("strike"), F.col("forward_price")))
    return out.where("tenor_days > 0 AND strike > 0 AND forward_price > 0").withColumn("mid_price", F.col("coin_price") * F.col("forward_price"))


def solved_options(options: DataFrame, forwards: DataFrame, risk_free_rate: float = 0.0) -> DataFrame:
    """Quotes with the solver's whole outcome, for diagnostics."""
    priced = _priced(options, forwards)
    s = implied_volatility_solution(F.col("mid_price"), F.col("forward_price"), F.col("strike"), F.col("tenor_days") / 365.25, F.lit(risk_free_rate), F.col("option_type"))
    return priced.withColumn("s", s).select("*", "s.*").drop("s", "coin_price")


def compute_option_iv(options: DataFrame, forwards: DataFrame, risk_free_rate: float = 0.0) -> DataFrame:
    """IV points of binned option mids (in coin) and a forward curve; rows without an IV are dropped."""
    return solved_options(options, forwards, risk_free_rate).where(finite(F.col("implied_vol"))).select(*IV_COLUMNS)


def construct_iv_surface(options_book: DataFrame, futures_book: DataFrame, freq: str = "5min", risk_free_rate: float = 0.0) -> DataFrame:
    """IV points from raw books of any number of days: standard names, two-sided mids, last quote of each bin, IV.

    One lazy plan; days are partitions of the scan, not a loop.  A bin keeps
    its last two-sided quote, as the mid is taken before binning.
    """
    futures = bin_orderbook(trim_orderbook(standardize_orderbook_columns(futures_book), 0), freq)
    forwards = forward_curve(futures).where(F.col("expiry").isNotNull())
    options = bin_orderbook(trim_orderbook(standardize_orderbook_columns(options_book), 0), freq)
    return compute_option_iv(with_known_expiry(options, forwards), forwards, risk_free_rate)


# ---- trades: as-of prices ----


def _iv_from_marks(marks: DataFrame, futures: DataFrame, at: Column, on: list[str], price: str, risk_free_rate: float, coin_price: bool) -> DataFrame:
    """IV of option prices against the future of the same expiry.

    ``coin_price``: the price is a share of the forward and is converted; else
    it goes to the formula as it is.
    """
    p = parse_option_instrument(F.col("instrument_name"))
    o = marks.withColumn("p", p).where(F.col("p").isNotNull()).select("*", "p.*").drop("p")
    o = o.withColumn("future_name", F.concat(F.split_part(F.col("instrument_name"), F.lit("-"), F.lit(1)), F.lit("-"), F.col("expiry")))
    f = futures.select(*on, F.col("instrument_name").alias("future_name"), F.col("price").alias("forward_price"), F.col("age_seconds").alias("future_age_seconds"))
    joined = o.join(f, [*on, "future_name"], "inner").withColumn("tenor_years", tenor_years(short_expiry(F.col("expiry")), at)).where("tenor_years > 0")
    value = F.col(price) * F.col("forward_price") if coin_price else F.col(price)
    iv = black76_implied_volatility(value, F.col("forward_price"), F.col("strike"), F.col("tenor_years"), F.lit(risk_free_rate), F.col("option_type"))
    out = joined.withColumn("log_moneyness", log_moneyness(F.col("strike"), F.col("forward_price"))).withColumn("implied_vol", iv)
    return out.where(finite(F.col("implied_vol")) & (F.col("implied_vol") > 0))


_ASOF_COLUMNS = ("expiry", "strike", "option_type", "mark_price", "forward_price", "log_moneyness", "tenor_years", "implied_vol", "mark_age_seconds", "future_age_seconds")


def compute_iv_at_timestamp(options: DataFrame, futures: DataFrame, at_ms: int, lookback_seconds: int = 21600, risk_free_rate: float = 0.0, coin_price: bool = False) -> DataFrame:
    """IV of every option at a time, from its latest mark and the latest price of its future.

    Marks are prices as the formula takes them; ``coin_price`` converts shares of the forward.
    """
    o = latest_at(options, at_ms, ["instrument_name"], "timestamp", ["mark_price"], lookback_seconds * 1000).where(F.col("mark_price").isNotNull()).withColumnRenamed("age_seconds", "mark_age_seconds")
    f = latest_at(futures, at_ms, ["instrument_name"], "timestamp", ["price"], lookback_seconds * 1000)
    return _iv_from_marks(o, f, F.lit(at_ms), [], "mark_price", risk_free_rate, coin_price).select(*_ASOF_COLUMNS)


def prepare_iv_timeseries(options: DataFrame, futures: DataFrame, time_step_minutes: int = 5, lookback_seconds: int = 21600, risk_free_rate: float = 0.0, coin_price: bool = False) -> DataFrame:
    """As ``compute_iv_at_timestamp`` for a grid of times, with the time as ``ts``; one as-of plan instead of a loop."""
    step, limit = time_step_minutes * 60_000, lookback_seconds * 1000
    ends = grid_ends(options, "timestamp")
    grid = lambda df, column: asof_grid(df, ["instrument_name"], "timestamp", [column], step, limit, ends or (0, -1)).where(F.col(column).isNotNull()).drop("timestamp_right")
    o, f = grid(options, "mark_price").withColumnRenamed("age_seconds", "mark_age_seconds"), grid(futures, "price")
    out = _iv_from_marks(o, f, F.col("timestamp"), ["timestamp"], "mark_price", risk_free_rate, coin_price)
    return out.select(F.col("timestamp").alias("ts"), *_ASOF_COLUMNS)


def trade_iv(trades: DataFrame, futures: DataFrame, center_ms: int, window_minutes: int = 10, lookback_seconds: int = 21600, risk_free_rate: float = 0.0, coin_price: bool = False) -> DataFrame:
    """IV of the trades around a time at their own prices, against futures as of that time."""
    half = window_minutes * 60_000
    near = trades.where(F.col("timestamp").between(center_ms - half, center_ms + half)).select("instrument_name", "timestamp", "price", "amount", "direction")
    f = latest_at(futures, center_ms, ["instrument_name"], "timestamp", ["price"], lookback_seconds * 1000)
    out = _iv_from_marks(near.withColumnRenamed("price", "trade_price"), f, F.lit(center_ms), [], "trade_price", risk_free_rate, coin_price)
    return out.withColumn("time_offset", (F.col("timestamp") - center_ms) / 1000)


# ---- interpolation ----


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of point numbers) of distinct points, by insertion along the longer axis.

    Edges of the hull are held as triangles with a point at infinity (number n),
    whose circle is the half-plane beyond the edge, so hull points in line or
    axes of very different scale lose nothing.  A triangle whose circle lies
    behind the sweep is final and no longer looked at.  Points on one line have
    no triangles.
    """
    n, none = len(points), np.zeros((0, 3), int)
    if n < 3:
        return none
    p = points - points.mean(axis=0)
    span = max(float(np.ptp(p, axis=0).max()), 1e-300)
    along = int(np.argmax(np.ptp(p, axis=0)))
    order = np.lexsort((p[:, 1 - along], p[:, along]))
    first, second = order[:2]
    off = np.abs(_turn(p[first], p[second], p[order]))
    third = np.flatnonzero(off > 1e-13 * span * np.hypot(*(p[order] - p[first]).T))
    if not len(third):
        return none
    start = np.array([first, second, order[third[0]]])
    inside = p[start].mean(axis=0)
    triangles, ends = start[None, :], np.array([_front(p[start][None], along)[0]])
    hull = np.array([[start[0], start[1]], [start[1], start[2]], [start[0], start[2]]])
    final = []
    for i in order:
        if i in start:
            continue
        past = ends < p[i, along] - 1e-9 * span
        if past.sum() > 32:
            final.append(triangles[past])
            triangles, ends = triangles[~past], ends[~past]
        bad = _in_circle(p[triangles], p[i])
        a, b = p[hull[:, 0]], p[hull[:, 1]]
        side = _turn(a, b, p[i]) * -np.sign(_turn(a, b, inside))
        length = np.hypot(*(b - a).T)
        step = ((p[i] - a) * (b - a)).sum(axis=1)
        level = np.abs(side) <= 1e-14 * span * length
        seen = np.where(level, (step > 0) & (step < length**2), side > 0)
        gone, lost = triangles[bad], hull[seen]
        edges = np.vstack([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]], lost, *(np.column_stack([lost[:, k], np.full(len(lost), n)]) for k in range(2))])
        edges, count = np.unique(np.sort(edges, axis=1), axis=0, return_counts=True)
        rim = edges[count == 1]
        outer = rim[:, 1] == n
        new = np.column_stack([rim[~outer], np.full((~outer).sum(), i)])
        hull = np.vstack([hull[~seen], np.column_stack([rim[outer, 0], np.full(outer.sum(), i)])])
        triangles, ends = np.vstack([triangles[~bad], new]), np.concatenate([ends[~bad], _front(p[new], along)])
    return np.vstack([*final, triangles])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of the triangles a, b, c."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _in_circle(corners: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether ``x`` is inside the circle of each triangle (points on it are not)."""
    d = corners - x
    size = (d * d).sum(axis=2)
    parts = np.stack([size[:, k] * (d[:, (k + 1) % 3, 0] * d[:, (k + 2) % 3, 1] - d[:, (k + 2) % 3, 0] * d[:, (k + 1) % 3, 1]) for k in range(3)])
    return parts.sum(axis=0) * np.sign(_turn(corners[:, 0], corners[:, 1], corners[:, 2])) > 1e-13 * np.abs(parts).max(axis=0)


def _front(corners: np.ndarray, along: int) -> np.ndarray:
    """The furthest coordinate of the circle of each triangle on one axis; infinite for a flat one."""
    u, v = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    d = 2 * (u[:, 0] * v[:, 1] - v[:, 0] * u[:, 1])
    su, sv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    with np.errstate(all="ignore"):
        o = np.column_stack([(su * v[:, 1] - sv * u[:, 1]) / d, (sv * u[:, 0] - su * v[:, 0]) / d])
        end = corners[:, 0, along] + o[:, along] + np.hypot(*o.T)
    return np.where(np.isfinite(end), end, np.inf)


def _gradients(points: np.ndarray, values: np.ndarray, triangles: np.ndarray, tolerance: float = 1e-12, rounds: int = 400) -> np.ndarray:
    """Gradient at each point that makes the cubics along all edges bend least (Nielson 1983).

    On an edge of length L with rise r and slopes u, v along it the bending is
    4 (u² + uv + v² - 3r (u + v) + 3r²) / L³.  All points are solved for at once
    from the last values of their neighbours; as an edge couples its ends half
    as strongly as it holds each, the error halves in every round.
    """
    n = len(points)
    edges = np.unique(np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]), axis=1), axis=0)
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    e = points[b] - points[a]
    w = 1 / (e * e).sum(axis=1) ** 1.5
    xx, xy, yy = (np.bincount(a, 4 * w * p * q, n) for p, q in ((e[:, 0], e[:, 0]), (e[:, 0], e[:, 1]), (e[:, 1], e[:, 1])))
    det = xx * yy - xy * xy
    det = np.where(det > 0, det, np.inf)
    rise, g = 6 * (values[b] - values[a]), np.zeros((n, 2))
    for _ in range(rounds):
        pull = w * (rise - 2 * (e * g[b]).sum(axis=1))
        sx, sy = np.bincount(a, pull * e[:, 0], n), np.bincount(a, pull * e[:, 1], n)
        new = np.column_stack([(yy * sx - xy * sy) / det, (xx * sy - xy * sx) / det])
        moved = np.abs(new - g).max(axis=1) / np.maximum(1, np.abs(new).max(axis=1))
        g = new
        if moved.max(initial=0) < tolerance:
            break
    return g


def _across(points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """For each triangle and corner: how the slope across the opposite edge is directed.

    The direction leads to the centroid of the triangle on the other side, so
    that it is the same from both sides and under affine maps; at the hull it
    is that of the median.
    """
    m = len(triangles)
    sides = np.sort(np.concatenate([triangles[:, [1, 2]], triangles[:, [2, 0]], triangles[:, [0, 1]]]), axis=1)
    _, side = np.unique(sides, axis=0, return_inverse=True)
    order = np.argsort(side.ravel(), kind="stable")
    twin = np.flatnonzero(np.diff(side.ravel()[order]) == 0)
    other = np.full(3 * m, -1)
    other[order[twin]], other[order[twin + 1]] = order[twin + 1] % m, order[twin] % m
    p, out = points[triangles], np.full((m, 3), -0.5)
    u, v = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    det = u[:, 0] * v[:, 1] - v[:, 0] * u[:, 1]
    center = p.mean(axis=1)
    for k in range(3):
        near = other[k * m : (k + 1) * m]
        d = center[near] - p[:, 0]
        c1, c2 = (d[:, 0] * v[:, 1] - v[:, 0] * d[:, 1]) / det, (u[:, 0] * d[:, 1] - d[:, 0] * u[:, 1]) / det
        c = (1 - c1 - c2, c1, c2)
        i, j = (k + 1) % 3, (k + 2) % 3
        out[:, k] = np.where(near >= 0, (2 * c[j] + c[i] - 1) / (2 - 3 * c[i] - 3 * c[j]), -0.5)
    return out


def _clough_tocher(points: np.ndarray, values: np.ndarray, g: np.ndarray, t: np.ndarray, across: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Value of the Clough-Tocher element with these corners, slopes across edges and barycentric weights (one row each).

    Three cubics in Bézier form that meet at the centroid; once continuously
    differentiable over the triangulation.
    """
    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    f = [values[t[:, i]] for i in range(3)]
    edge = {(i, j): f[i] + (g[t[:, i]] * (points[t[:, j]] - points[t[:, i]])).sum(axis=1) / 3 for i, j in pairs}
    inner = [(f[i] + edge[i, (i + 1) % 3] + edge[i, (i + 2) % 3]) / 3 for i in range(3)]
    face = []
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        bend = f[j] - f[i] + 3 * (edge[i, j] - edge[j, i])
        face.append((across[:, k] * bend - f[i] + 2 * edge[i, j] - edge[j, i] + inner[i] + inner[j]) / 2)
    upper = [(face[(i + 1) % 3] + face[(i + 2) % 3] + inner[i]) / 3 for i in range(3)]
    low = weights.min(axis=1)
    d, top = [weights[:, i] - low for i in range(3)], 3 * low
    out = top**3 * (upper[0] + upper[1] + upper[2]) / 3
    for i, j in pairs:
        out = out + 3 * d[i] ** 2 * d[j] * edge[i, j]
    for k in range(3):
        out = out + d[k] ** 3 * f[k] + 3 * d[k] ** 2 * top * inner[k] + 3 * d[k] * top**2 * upper[k] + 6 * d[(k + 1) % 3] * d[(k + 2) % 3] * top * face[k]
    return out


def _locate(points: np.ndarray, triangles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at``: the first triangle that holds it (-1: none) and its barycentric weights there."""
    owner, weights = np.full(len(at), -1), np.zeros((len(at), 3))
    rows = max(1, 1_000_000 // max(1, len(at)))
    for lo in range(0, len(triangles), rows):
        open_ = np.flatnonzero(owner < 0)
        if not len(open_):
            break
        a, b, c = (points[triangles[lo : lo + rows, k]] for k in range(3))
        u, w = b - a, c - a
        det = u[:, 0] * w[:, 1] - w[:, 0] * u[:, 1]
        flat = np.abs(det) < 1e-14
        det = np.where(flat, np.nan, det)[:, None]
        x, y = (at[open_, k][None, :] - a[:, k : k + 1] for k in range(2))
        l1 = (x * w[:, 1:] - y * w[:, :1]) / det
        l2 = (y * u[:, :1] - x * u[:, 1:]) / det
        with np.errstate(invalid="ignore"):
            holds = (l1 >= -1e-9) & (l2 >= -1e-9) & (1 - l1 - l2 >= -1e-9)
        found = holds.any(axis=0)
        which, where = holds.argmax(axis=0)[found], np.flatnonzero(found)
        owner[open_[where]] = lo + which
        m1, m2 = l1[which, where], l2[which, where]
        weights[open_[where]] = np.stack([1 - m1 - m2, m1, m2], axis=1)
    return owner, weights


def interpolate(points: np.ndarray, values: np.ndarray, at: np.ndarray, cubic: bool = True) -> np.ndarray:
    """Values at ``at`` from scattered data; NaN outside the hull.

    The triangles are those of the coordinates as they are.  Linear: barycentric.
    Cubic: Clough-Tocher with the gradients of least bending.  Where the cubic
    is not finite the linear value stands.  Equal points count once, with their
    mean value.  Fewer than three points, or points on one line, give NaN
    everywhere.
    """
    out = np.full(len(at), np.nan)
    points, inverse = np.unique(points, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    values = np.bincount(inverse, values) / np.bincount(inverse)
    if len(points) < 3:
        return out
    triangles = delaunay(points)
    if not len(triangles):
        return out
    owner, weights = _locate(points, triangles, at)
    inside = np.flatnonzero(owner >= 0)
    if not len(inside):
        return out
    t, weights = triangles[owner[inside]], weights[inside]
    v = (values[t] * weights).sum(axis=1)
    if cubic:
        with np.errstate(all="ignore"):
            c = _clough_tocher(points, values, _gradients(points, values, triangles), t, _across(points, triangles)[owner[inside]], weights)
        v = np.where(np.isfinite(c), c, v)
    out[inside] = v
    return out


def surface_box(m: np.ndarray, tenor: np.ndarray, low: float = 5, high: float = 95, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Grid ends: quantiles widened by a tenth of their range."""
    ends = []
    for x in (m, tenor):
        a, b = np.percentile(x, [low, high])
        ends.append(np.array([a - 0.1 * (b - a), b + 0.1 * (b - a)]))
    ends[1][0] = max(ends[1][0], floor)
    return ends[0], ends[1]


def surface_grid(iv: DataFrame, resolution: int = 40, cubic: bool = True, box: tuple[float, float] = (5, 95), tenor_floor: float = 1e-6, time: str = "timestamp", tenor: str = "tenor_days") -> DataFrame:
    """(timestamp, i, j, log_moneyness, tenor_days, iv): a grid per time, iv null outside the data's hull.

    Times with fewer than three finite points have no grid.  A time's points
    are the quotes of one bin, so a group is as large as the instrument list.
    """
    good = iv.where(finite(F.col("log_moneyness")) & finite(F.col(tenor)) & finite(F.col("implied_vol")) & (F.col(tenor) > 0)).select(F.col(time).alias("timestamp"), "log_moneyness", F.col(tenor).alias("tenor"), "implied_vol")

    def grid(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["log_moneyness", "tenor", "implied_vol"])
        m, t, v = (df[c].to_numpy(float) for c in ("log_moneyness", "tenor", "implied_vol"))
        if len(m) < 3:
            return pd.DataFrame({c: [] for c in ("timestamp", "i", "j", "log_moneyness", "tenor_days", "iv")})
        mx, tx = surface_box(m, t, *box, tenor_floor)
        gm, gt = np.meshgrid(np.linspace(*mx, resolution), np.linspace(*tx, resolution))
        at = np.column_stack([gm.ravel(), gt.ravel()])
        z = interpolate(np.column_stack([m, t]), v, at, cubic)
        j, i = (x.ravel() for x in np.meshgrid(np.arange(resolution), np.arange(resolution)))
        return pd.DataFrame({"timestamp": df["timestamp"].iloc[0], "i": i, "j": j, "log_moneyness": at[:, 0], "tenor_days": at[:, 1], "iv": z})

    out = good.groupBy("timestamp").applyInPandas(grid, "timestamp bigint, i int, j int, log_moneyness double, tenor_days double, iv double")
    return out.withColumn("iv", F.nanvl("iv", F.lit(None).cast("double")))


def interpolate_surface(iv: DataFrame, grid_resolution: int = 50, time: str = "ts", tenor: str = "tenor_years") -> DataFrame:
    """The trade viewer's grid: box from the extremes, tenor not below 0."""
    return surface_grid(iv, grid_resolution, True, (0, 100), 0.0, time, tenor)
