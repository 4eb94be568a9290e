"""Vector-embedding maintenance and search over a node graph, on Spark DataFrames."""
