"""The analytics: every function takes and returns DataFrames."""
