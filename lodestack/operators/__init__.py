"""DataFrame operators: each takes DataFrames and returns one; every search is batched over a queries table."""
