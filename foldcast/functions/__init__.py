"""Column expressions: dates, special functions, sampling, metrics, text."""
