"""Column expressions: symbols, time, Black-76 and small scalars."""
