"""Square-lattice coordinates. Sites are numbered from 1 by rows, v = (i - 1) * L + j; edges are (u, w) with u < w."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def row_of(v: Column, L) -> Column:
    return (F.floor((v - 1) / _c(L)) + 1).cast("int")


def col_of(v: Column, L) -> Column:
    return (F.pmod(v - 1, _c(L)) + 1).cast("int")


def site(i: Column, j: Column, L) -> Column:
    """The site at (i, j), or -1 outside the lattice."""
    inside = (i >= 1) & (i <= _c(L)) & (j >= 1) & (j <= _c(L))
    return F.when(inside, (i - 1) * _c(L) + j).otherwise(F.lit(-1)).cast("int")


def wrap(x: Column, L) -> Column:
    """x taken into 1..L."""
    return (F.pmod(x - 1, _c(L)) + 1).cast("int")


def translate(v: Column, di, dj, L: int, boundary: str = "periodic") -> Column:
    """v moved by (di, dj): around the torus, or -1 beyond an open boundary."""
    i, j = row_of(v, L) + di, col_of(v, L) + dj
    return site(wrap(i, L), wrap(j, L), L) if boundary == "periodic" else site(i, j, L)


def distance(a: Column, b: Column, L: int, boundary: str = "periodic") -> Column:
    """Manhattan distance of two sites, around the torus if periodic."""
    di, dj = F.abs(row_of(a, L) - row_of(b, L)), F.abs(col_of(a, L) - col_of(b, L))
    if boundary == "periodic":
        di, dj = F.least(di, F.lit(L) - di), F.least(dj, F.lit(L) - dj)
    return (di + dj).cast("int")


def centre_site(L: Column) -> Column:
    """The site in the middle, for an even L the one above and left of it."""
    half = F.floor((L + 1) / 2)
    return ((half - 1) * L + half).cast("int")


def edge(a: Column, b: Column) -> Column:
    """The edge of two sites with the smaller first."""
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w"))


def edge_key(edges: Column) -> Column:
    """A sorted edge array as text, the same for equal sets."""
    return F.array_join(F.transform(F.array_sort(edges), lambda e: F.concat_ws("-", e["u"].cast("string"), e["w"].cast("string"))), ";")


# The eight symmetries of the square as matrices (a, b, c, d), (i, j) -> (a i + b j, c i + d j).
D4: Sequence[tuple[int, int, int, int]] = ((1, 0, 0, 1), (-1, 0, 0, -1), (0, 1, -1, 0), (0, -1, 1, 0), (1, 0, 0, -1), (-1, 0, 0, 1), (0, 1, 1, 0), (0, -1, -1, 0))


def square_image(i: Column, j: Column, k: int) -> tuple[Column, Column]:
    """(i, j) under the k-th symmetry, about the origin."""
    a, b, c, d = D4[k]
    return a * i + b * j, c * i + d * j
