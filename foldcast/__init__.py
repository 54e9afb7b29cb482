"""Feature preparation, backtesting and scoring of count forecasts on Spark."""
