"""DataFrame operators: each takes and returns DataFrames and runs nothing itself
unless its docstring says so."""
