"""Session helpers: the shared folder, written tables, sizes that are checked before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of rows that a side may have to be broadcast, whatever its row count.
BROADCAST_BYTES = 128 << 20
_written: list[str] = []
_named: list[str] = []
#: Where the tables that DataFrames stand for lie: a reference to the frame, its path, its name.
_places: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all is local a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tensorloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: an iteration's lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tensorloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path, None)
    return out


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """table(), in n buckets of the keys: joins and groupings by them read it without a shuffle, if they have n partitions."""
    spark, name = df.sparkSession, f"tensorloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    _written.append(path)
    _named.append(name)
    out = spark.table(name)
    _places[id(out)] = (weakref.ref(out), path, name)
    return out


def drop(df: DataFrame) -> None:
    """Delete what table() or bucketed() wrote for df, once nothing that reads it is needed; other tables are left alone."""
    at, path, name = _places.pop(id(df), (None, None, None))
    if at is None or at() is not df:
        return
    if name is not None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _named.remove(name)
    _delete(df.sparkSession, path)
    _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the plans that are run inside."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def clear(spark: SparkSession) -> int:
    """Delete the tables written so far, once no result that reads them is needed any more; how many there were."""
    n = len(_written)
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _written:
        _delete(spark, _written.pop())
    _places.clear()
    return n


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _width(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) + 16
    return F.lit(8 * (len(kind.fields) if isinstance(kind, T.StructType) else 1))


def small(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes, else df as it is. It is read for that: write it first."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(sum((_width(f) for f in df.schema), F.lit(0)).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df
