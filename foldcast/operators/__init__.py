"""DataFrame operators. Every operator takes and returns DataFrames."""
