"""The shared folder, written tables and the sizes that a broadcast is bound to."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tensorloom import session


def test_a_cluster_needs_a_shared_folder():
    fake = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
    assert session.shared_dir(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"


def test_written_tables_are_cleared(spark):
    session.clear(spark)
    t = session.table(spark.range(5))
    assert t.count() == 5 and session.clear(spark) == 1 and session.clear(spark) == 0


def test_small_counts_rows_and_bytes(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.sequence(F.lit(1), F.lit(50)).alias("a"), F.struct("id").alias("t"))
    assert hint(session.small(few, 10)) and not hint(session.small(few, 9)) and not hint(session.small(few, 10, 5_000)) and hint(session.small(few.limit(0), 0))
