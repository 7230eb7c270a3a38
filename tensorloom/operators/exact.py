"""Exact contraction by rows, and corner transfer matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .contract import contract_network


def ising_rows(spark: SparkSession, L: int, betas: list[float]) -> DataFrame:
    """(beta, logz): the L x L ferromagnetic torus exactly, spins on sites, one site absorbed at a time.

    A state row is the mask of the first row, the mask of the current one and a weight: 2^(2L) rows for each beta.
    """
    grid = F.broadcast(spark.createDataFrame([(float(b),) for b in betas], "beta double"))
    spin = lambda mask, k: 1 - 2 * F.shiftright(mask, k).bitwiseAND(F.lit(1))
    ring = lambda mask: sum((spin(mask, k) * spin(mask, (k + 1) % L) for k in range(L)), F.lit(0))
    masks = spark.range(1 << L).select(F.col("id").alias("m"))
    state = masks.join(grid).select("beta", F.col("m").alias("first"), F.col("m").alias("now"), F.exp(F.col("beta") * ring(F.col("m"))).alias("w"), F.lit(0.0).alias("shift"))
    for _ in range(L - 1):
        for k in range(L):
            both = state.select("beta", "first", "now", "w", "shift", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
            keep = F.col("now").bitwiseAND(F.lit((1 << L) - 1 - (1 << k)))
            e = F.exp(F.col("beta") * spin(F.col("now"), k) * (1 - 2 * F.col("b")))
            state = both.groupBy("beta", "first", keep.bitwiseOR(F.shiftleft(F.col("b").cast("long"), k)).alias("now")).agg(F.sum(F.col("w") * e).alias("w"), F.first("shift").alias("shift"))
        state = state.withColumn("w", F.col("w") * F.exp(F.col("beta") * ring(F.col("now"))))
        top = state.groupBy("beta").agg(F.max("w").alias("top"))
        state = table(state.join(F.broadcast(top), "beta").select("beta", "first", "now", (F.col("w") / F.col("top")).alias("w"), (F.col("shift") + F.log("top")).alias("shift")))
    cross = sum((spin(F.col("first"), k) * spin(F.col("now"), k) for k in range(L)), F.lit(0))
    return state.groupBy("beta").agg((F.log(F.sum(F.col("w") * F.exp(F.col("beta") * cross))) + F.max("shift")).alias("logz"))


def sheet(tensors: DataFrame, slots: DataFrame) -> DataFrame:
    """(g, re): an open sheet row by row without truncation; the state grows with the width. ValueError below two rows."""
    if slots.select("v").distinct().count() < 2:
        raise ValueError("needs two rows at least")
    return contract_network(tensors, slots)


def _boundary(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, cols, cutoff, most = (pdf[c].iloc[0] for c in ("rows", "cols", "cutoff", "most"))
    site: dict[int, np.ndarray] = {}
    for v, part in pdf.groupby("v"):
        i, j = divmod(int(v) - 1, int(cols))
        # Legs of the full tensor: up, down, left, right; those over the edge have dimension 1.
        there = [i > 0, i < rows - 1, j > 0, j < cols - 1]
        idx = np.array(part["idx"].tolist()) - 1
        shape = iter(idx.max(axis=0) + 1)
        t = np.zeros([next(shape) if x else 1 for x in there])
        full = np.zeros((len(idx), 4), int)
        full[:, [k for k in range(4) if there[k]]] = idx
        t[tuple(full.T)] = part["re"]
        site[i, j] = t
    log, state = 0.0, [site[0, j][0].transpose(1, 0, 2) for j in range(int(cols))]
    for i in range(1, int(rows)):
        # The row is applied, brought into orthogonal form from the left, then cut by singular values from the right.
        grown = [np.einsum("ldr,duxy->lxury", a, site[i, j]).reshape(a.shape[0] * site[i, j].shape[2], site[i, j].shape[1], -1) for j, a in enumerate(state)]
        for j in range(int(cols) - 1):
            l, d, r = grown[j].shape
            q, x = np.linalg.qr(grown[j].reshape(l * d, r))
            grown[j], grown[j + 1] = q.reshape(l, d, -1), np.tensordot(x, grown[j + 1], 1)
        for j in range(int(cols) - 1, 0, -1):
            l, d, r = grown[j].shape
            u, w, vt = np.linalg.svd(grown[j].reshape(l, d * r), full_matrices=False)
            tail = np.cumsum(w[::-1] ** 2)[::-1] / max(float((w**2).sum()), 1e-300)
            keep = max(1, min(int(most), int((tail > cutoff).sum())))
            grown[j], grown[j - 1] = vt[:keep].reshape(keep, d, r), np.tensordot(grown[j - 1], u[:, :keep] * w[:keep], 1)
        size = float(np.abs(grown[0]).max())
        log, grown[0] = log + math.log(size), grown[0] / size
        state = grown
    end = np.ones((1, 1))
    for a in state:
        end = np.tensordot(end, a[:, 0, :], 1)
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "logz": [log + math.log(abs(float(end[0, 0])))], "sign": [float(np.sign(end[0, 0]))]})


def boundary(tensors: DataFrame, rows: int, cols: int, cutoff: float = 1e-8, most: int = 40) -> DataFrame:
    """(g, logz, sign): an open sheet by a boundary state of bounded bond dimension, one row at a time; one task for each point.

    Tensors are numbered by rows with legs up, down, left, right where they exist. ValueError below two rows.
    """
    if rows < 2:
        raise ValueError("needs two rows at least")
    t = tensors.select("g", "v", "idx", "re", F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.lit(cutoff).alias("cutoff"), F.lit(most).alias("most"))
    return t.groupBy("g").applyInPandas(_boundary, "g double, logz double, sign double")


def _double_tensor(a1: float, a2: float) -> np.ndarray:
    """The deformed spin-2 state's norm tensor, legs l, b, r, t of dimension 4."""
    t = np.zeros((5, 2, 2, 2, 2))
    weight = [a2 / math.sqrt(6), a1 / math.sqrt(1.5), 1.0, a1 / math.sqrt(1.5), a2 / math.sqrt(6)]
    for legs in np.ndindex(2, 2, 2, 2):
        ups = 4 - sum(legs)
        t[(ups, *legs)] = weight[ups] / math.sqrt(math.comb(4, ups))
    singlet = np.array([[0.0, 1.0], [-1.0, 0.0]])
    t = np.einsum("pabrt,la,kb->plkrt", t, singlet, singlet)
    return np.einsum("plbrt,pmcsu->lmbcrstu", t, t).reshape(4, 4, 4, 4)


def _corner(pdf: pd.DataFrame) -> pd.DataFrame:
    a1, a2, chi, cutoff, steps = (pdf[c].iloc[0] for c in ("a1", "a2", "chi", "cutoff", "steps"))
    t = _double_tensor(a1, a2)
    # Legs of t: left, bottom, right, top. c is a corner; a is an edge: its two ends and the leg that faces the centre.
    c, a = np.ones((1, 1)), np.zeros((1, 1, 4))
    a[0, 0, 0] = 1.0
    for _ in range(int(steps)):
        n = 4 * len(c)
        grown = np.einsum("axs,ab,byv,zwsv->yzxw", a, c, a, t, optimize="greedy").reshape(n, n)
        value, vector = np.linalg.eigh((grown + grown.T) / 2)
        order = np.argsort(-np.abs(value))[: int(chi)]
        keep = [k for rank, k in enumerate(order) if rank == 0 or value[k] ** 2 > cutoff * (value**2).sum()]
        u = vector[:, keep].reshape(-1, 4, len(keep))
        c = np.diag(value[keep]) / np.abs(value[keep]).max()
        a = np.einsum("xys,zwsv,xvp,ywq->pqz", a, t, u, u, optimize="greedy")
        a = a / np.abs(a).max()
    # A half plane is an edge between two corners. One site and a row's edges between two halves, times two facing pairs
    # of corners, over two facing halves squared.
    half = np.einsum("xys,xp,yq->pqs", a, c, c)
    full = np.einsum("pqs,pxv,qyw,zwsv,xyz->", half, a, a, t, half, optimize="greedy")
    ring = np.trace(c @ c @ c @ c)
    return pd.DataFrame({"a1": [a1], "a2": [a2], "log_kappa": [float(np.log(abs(full * ring / (half * half).sum() ** 2)))]})


def corner_free_energy(points: DataFrame, chi: int = 32, cutoff: float = 1e-14, steps: int = 60) -> DataFrame:
    """(a1, a2, log_kappa): log of the norm per site of the deformed spin-2 state by corner transfer matrices; one task for each point."""
    p = points.select("a1", "a2", F.lit(chi).alias("chi"), F.lit(cutoff).alias("cutoff"), F.lit(steps).alias("steps"))
    return p.groupBy("a1", "a2").applyInPandas(_corner, "a1 double, a2 double, log_kappa double")
