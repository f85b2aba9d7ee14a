"""DataFrame-in, DataFrame-out operators of the tabular workflow."""
