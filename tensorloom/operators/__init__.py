"""Operators: contraction, belief propagation, loops, clusters, series, codes, exact contraction, statistics."""
