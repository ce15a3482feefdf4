"""SQL oracles: every query again, as one DuckDB statement over the driver tables."""
