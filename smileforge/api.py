"""The public functions by name, in one place."""

from .functions.black76 import black76_call_price, black76_implied_volatility, black76_implied_volatility_vectorized, black76_price, black76_put_price, black76_vega, log_moneyness, moneyness
from .functions.symbols import parse_future_name, parse_option_instrument, parse_option_name, regex_symbol
from .operators.analytics import create_value_pivot, create_volume_pivot
from .operators.asof import asof_grid, asof_join, get_futures_prices_at_time, trades_window
from .operators.orderbook import bin_orderbook, get_option_combos, standardize_orderbook_columns, trim_orderbook
from .operators.plots import create_heatmap, create_iv_surface_plot, create_iv_surface_viewer, create_scatter_trace, create_surface_trace, create_trade_scatter_trace, plot_prices
from .operators.surface import compute_iv_at_timestamp, compute_option_iv, construct_iv_surface, interpolate_surface, prepare_iv_timeseries, surface_grid, trade_iv
from .sources.archive import fetch_market_data, index_lister, read_book, read_index, read_module
from .sources.history import construct_iv_surface_from_archive
from .sources.planner import create_date_chunks
from .sources.trades import get_trades, get_trades_by_instrument, one_page, read_instruments, read_pages

__all__ = [n for n in dir() if not n.startswith("_")]
