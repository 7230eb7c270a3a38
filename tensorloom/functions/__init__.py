"""Scalar functions on columns: coordinates of lattices, canonical keys, physics constants."""
