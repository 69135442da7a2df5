"""Plot data.  Each function returns a small dict for any drawing library; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, lookup, marker_size, staleness
from .analytics import axis_bounds, create_volume_pivot, enough, strike_rank, viewer_bounds, wide
from .surface import interpolate_surface, surface_grid

COLOURS = {"buy": "green", "sell": "red"}
OTHER_COLOUR = "gray"


def _records(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict() for r in (df.limit(limit) if limit else df).collect()]


def create_iv_surface_plot(iv: DataFrame, grid_resolution: int = 40, title: str = "Implied volatility surface") -> dict:
    """Frames (one per time) of surface grids with common axis bounds."""
    good = enough(iv.where(finite(F.col("implied_vol")) & (F.col("implied_vol") > 0)), "timestamp")
    grid = surface_grid(good, grid_resolution).orderBy("timestamp", "i", "j")
    return {"title": title, "axes": _records(axis_bounds(good, "log_moneyness", "tenor_days", "implied_vol"))[0], "frames": grid}


def create_surface_trace(points: DataFrame, name: str, resolution: int = 50, time: str = "ts") -> dict:
    """A grid, or the points themselves where a time has fewer than three."""
    sizes = points.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    few = points.join(sizes.where("n < 3"), time, "left_semi")
    return {"name": name, "surface": interpolate_surface(points, resolution, time), "points": few}


def create_scatter_trace(points: DataFrame, name: str) -> dict:
    """Marks with their staleness (0 fresh, 1 six hours old or more)."""
    return {"name": name, "points": points.withColumn("staleness", staleness(F.greatest("mark_age_seconds", "future_age_seconds")))}


def create_trade_scatter_trace(trades_with_iv: DataFrame, name: str) -> dict:
    """Trades with size by amount and colour by direction."""
    return {"name": name, "points": trades_with_iv.withColumns({"size": marker_size(F.col("amount")), "colour": lookup(F.col("direction"), COLOURS, OTHER_COLOUR)})}


def create_iv_surface_viewer(iv_timeseries: DataFrame, trades_with_iv: DataFrame | None = None) -> dict:
    """Call and put traces with common bounds, and the trades around the chosen time."""
    sides = {n: iv_timeseries.where(F.col("option_type") == s) for n, s in (("calls", "C"), ("puts", "P"))}
    out = {"axes": _records(viewer_bounds(iv_timeseries, "log_moneyness", "tenor_years", "implied_vol"))[0]}
    for name, points in sides.items():
        out[name] = {"surface": create_surface_trace(points, name), "marks": create_scatter_trace(points, name)}
    if trades_with_iv is not None:
        out["trades"] = create_trade_scatter_trace(trades_with_iv, "trades")
    return out


def create_heatmap(rolling: DataFrame, index_hourly: DataFrame, title: str) -> dict:
    """Cells of the rolling pivot (zeros apart, as they are masked) and the index price's row in each hour."""
    return {"title": title, "cells": rolling.where("rolling <> 0"), "empty": rolling.where("rolling = 0"), "index": strike_rank(index_hourly, "index_price", rolling)}


def heatmap_table(trades: DataFrame) -> DataFrame:
    """Strikes by hours, as drawn."""
    return wide(create_volume_pivot(trades), "strike", "hour")


def plot_prices(trades: DataFrame, strike: int, option_type: str, start_ms: int, end_ms: int, resolution: str = "5") -> dict:
    """Buys, sells and marks of one option within a time range."""
    one = trades.where((F.col("strike") == strike) & (F.col("option_type") == option_type) & F.col("timestamp").between(start_ms, end_ms))
    return {
        "title": f"{strike} {option_type}, {resolution} min",
        "buys": one.where(F.col("direction") == "buy").select("timestamp", "price").orderBy("timestamp"),
        "sells": one.where(F.col("direction") == "sell").select("timestamp", "price").orderBy("timestamp"),
        "marks": one.select("timestamp", "mark_price").orderBy("timestamp"),
    }


def term_structure_frames(mids: DataFrame, fit: DataFrame, curve: DataFrame, time: str) -> dict:
    """Points, fit and curve of every time bin."""
    return {"points": mids.orderBy(time, "tenor"), "fit": fit.orderBy(time), "curve": curve.orderBy(time, "i")}
