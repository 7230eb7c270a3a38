"""Every registered query of the engine against its SQL in DuckDB on the small tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from tensorloom.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def rows(columns, data):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, (int, float)) and float(u) == pytest.approx(float(v), abs=2e-6))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_series_agree(spark, sf_dir):
    """Order by order the logarithm's series is that of the sum: the same up to weight 7, less half the square at 8."""
    z = {r["weight"]: r["at"] for r in QUERIES["z_series"](spark, sf_dir).collect()}
    log = {r["weight"]: r["at"] for r in QUERIES["logz_series"](spark, sf_dir).collect()}
    assert z[4] == log[4] and z[6] == log[6] and z[8] - log[8] == pytest.approx(z[4] ** 2 / 2, abs=1e-6)


def test_matching_leaves_nothing(spark, sf_dir):
    assert QUERIES["match_syndrome"](spark, sf_dir).first()["unmatched"] == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_critical_couplings_are_of_the_parts(spark, sf_dir):
    got = QUERIES["bethe_critical_beta"](spark, sf_dir)
    assert got.count() > 100 and got.inputFiles() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").inputFiles()


@pytest.fixture(scope="module")
def changed(spark, sf_dir, tmp_path_factory):
    """The small tables with other order lines: two years, a tax rate less, some nulls."""
    folder = tmp_path_factory.mktemp("changed")
    for name in os.listdir(sf_dir):
        if name != "lineitem.parquet":
            os.symlink(f"{sf_dir}/{name}", folder / name)
    null = "CASE WHEN l_partkey % {} = 0 THEN NULL ELSE {} END AS {}"
    columns = ", ".join(null.format(n, c, c) for n, c in [(7, "l_tax"), (11, "l_discount"), (13, "l_quantity"), (17, "l_shipdate"), (19, "l_extendedprice")])
    duckdb.sql(f"COPY (SELECT * REPLACE ({columns}) FROM '{sf_dir}/lineitem.parquet' WHERE year(l_shipdate) IN (1996, 1999) AND l_tax <> 0.04 AND l_discount <> 0.02) TO '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["bp_local_z", "bp_partition", "bp_residual", "bp_selective", "aklt_tensor", "aklt_norm", "all_loops", "bch_code", "bethe_free_energy", "bethe_vs_exact", "boundary_state"])
def test_follows_the_order_lines(spark, sf_dir, changed, name):
    """On other order lines the rows are others, and as the SQL has them."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{changed}/lineitem.parquet'")
    got, want = QUERIES[name](spark, changed), c.sql(ORACLES[name])
    found = rows(got.columns, got.collect())
    assert len(found) == len(expected := rows(want.columns, want.fetchall())) > 0
    for x, y in zip(found, expected, strict=True):
        assert all(u == v or float(u) == pytest.approx(float(v), abs=2e-6) for u, v in zip(x, y, strict=True))
    assert found != rows(got.columns, QUERIES[name](spark, sf_dir).collect())
