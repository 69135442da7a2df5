"""DataFrame operators: order book, as-of joins, analytics, volatility surfaces, plot data."""
