"""Singular values from merged triangular factors against those of the whole matrix."""

import numpy as np
import pytest

from tensorloom.operators import singular


def frame(spark, x, parts):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, x array<double>").repartition(parts)


@pytest.mark.parametrize(("n", "d", "parts"), [(200, 7, 20), (5, 8, 3), (64, 1, 4), (400, 12, 1)])
def test_all_values(spark, n, d, parts):
    x = np.random.default_rng(n).normal(size=(n, d)) @ np.diag(np.arange(1, d + 1))
    got = singular.singular_values(frame(spark, x, parts), "x")
    assert got == pytest.approx(np.linalg.svd(x, compute_uv=False)[: len(got)], rel=1e-10) and len(got) == min(n, d)


def test_merging_is_stacking():
    x = np.random.default_rng(1).normal(size=(90, 6))
    parts = [singular.triangle(p) for p in np.split(x, 9)]
    assert singular.triangle(np.concatenate(parts)) == pytest.approx(singular.triangle(x)) and all(len(p) <= 6 for p in parts)


def test_leading_values_of_a_falling_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 30)) @ np.diag(0.5 ** np.arange(30.0)) @ np.linalg.qr(rng.normal(size=(30, 30)))[0]
    got, want = singular.leading(frame(spark, x, 5), "x", 4), np.linalg.svd(x, compute_uv=False)[:4]
    assert got == pytest.approx(want, rel=1e-4) and (got <= want * (1 + 1e-12)).all()


def test_nulls_repeats_lengths_and_empty(spark):
    df = spark.createDataFrame([([3.0, 0.0],), (None,), ([1.0, None],), ([3.0, 0.0],), ([0.0, 2.0],)], "x array<double>")
    assert singular.singular_values(df, "x") == pytest.approx([18**0.5, 2.0])
    assert len(singular.singular_values(df.limit(0), "x")) == 0 and len(singular.leading(df.limit(0), "x", 2)) == 0
    with pytest.raises(Exception, match="entries"):
        singular.singular_values(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>").coalesce(1), "x")


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.select("embedding").collect()], dtype=float)
    want = np.linalg.svd(x, compute_uv=False)
    assert singular.singular_values(df, "embedding") == pytest.approx(want[: x.shape[1]], rel=1e-8)
    got = singular.leading(df, "embedding", 5, extra=40)
    assert (got <= want[:5] * (1 + 1e-9)).all() and got == pytest.approx(want[:5], rel=0.1)
