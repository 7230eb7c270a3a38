"""Singular values of tall tables of vectors: triangular factors of parts merge like a sketch, and only the last one leaves the tasks.

The triangular factor of a QR decomposition has as many rows as the vectors have entries, whatever the number of vectors,
and that of two parts is the factor of their factors stacked. So each task keeps one, factors are merged eight at a
time, and the singular values of the last are those of the table. For wide vectors a random range of a few columns is
decomposed instead, and the vectors are projected on it in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table

#: Vectors that a task stacks on its factor at a time.
BLOCK = 2048
#: Entries that a vector may have: a merge holds eight square matrices of this size.
MOST_WIDTH = 2048


def triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangular factor of rows, with the diagonal not negative; as many rows as columns at most."""
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    if other := {len(x) for x in vectors} - {width}:
        raise ValueError(f"vectors of {min(other)} entries beside those of {width}")
    return np.stack([np.asarray(x, dtype=np.float64) for x in vectors]) if len(vectors) else np.zeros((0, width))


def _merged(parts: DataFrame, width: int) -> np.ndarray:
    """One factor from the parts' (x, part), eight at a time; at most `width` rows reach the driver."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": list(triangle(_stacked(f["x"], width))), "part": f["part"].iloc[0]})

    parts = table(parts)
    while parts.agg(F.max("part")).first()[0]:
        parts = table(parts.withColumn("part", F.floor(F.col("part") / 8).cast("int")).groupBy("part").applyInPandas(merge, "x array<double>, part int"))
    got = parts.collect()  # at most `width` rows
    return triangle(np.array([r["x"] for r in got])) if got else np.zeros((0, width))


def _vectors(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    rows = df.select(F.col(column).cast("array<double>").alias("x")).where(f"`{column}` IS NOT NULL AND NOT exists(`{column}`, v -> v IS NULL)")
    first = rows.select(F.size("x").alias("n")).first()
    width = first["n"] if first else 0
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of {width} entries")
    return rows, width


def factor(df: DataFrame, column: str, project: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor R of the table of vectors, R'R being their Gram matrix; or of the vectors times `project`."""
    rows, width = _vectors(df, column)
    out = width if project is None else project.shape[1]

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, out))
        for f in frames:
            for at in range(0, len(f), BLOCK):
                x = _stacked(f["x"].iloc[at : at + BLOCK], width)
                r = triangle(np.concatenate([r, x if project is None else x @ project]))
        if len(r):
            yield pd.DataFrame({"x": list(r)})

    return _merged(rows.mapInPandas(reduced, "x array<double>").withColumn("part", F.spark_partition_id()), out)


def singular_values(df: DataFrame, column: str) -> np.ndarray:
    """All singular values of the table whose rows are the vectors, falling. Null vectors and vectors with a null are left out; an empty table has none; vectors of different lengths raise an error."""
    r = factor(df, column)
    return np.linalg.svd(r, compute_uv=False) if len(r) else np.zeros(0)


def leading(df: DataFrame, column: str, k: int, extra: int = 10, seed: int = 0) -> np.ndarray:
    """The k largest singular values from a random range of k + extra columns: two passes, factors of k + extra rows.

    Values are never too large, and close where the spectrum falls off after k; singular_values() is exact.
    """
    rows, width = _vectors(df, column)
    if not width:
        return np.zeros(0)
    m = min(width, k + extra)
    project = np.random.default_rng(seed).normal(size=(width, m))
    r = factor(df, column, project)
    if len(r) < m:
        return singular_values(df, column)[:k]
    # With Y = XP = QR the range's coordinates of a vector x are x P R^-1; their products with x add up to Q'X.
    to_range = project @ np.linalg.pinv(r)

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, width))
        for f in frames:
            x = _stacked(f["x"], width)
            total += (x @ to_range).T @ x
        yield pd.DataFrame({"i": np.arange(m), "x": list(total)})

    sums = rows.mapInPandas(product, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    b = np.zeros((m, width))
    for x in sums.collect():  # m times width numbers
        b[x["i"], x["j"]] = x["v"]
    return np.linalg.svd(b, compute_uv=False)[:k]
