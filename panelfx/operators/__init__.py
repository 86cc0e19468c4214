"""DataFrame-level operators (each takes and returns DataFrames)."""
