"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let, shared_dir, small, table  # noqa: F401  used by the operators

#: White space of the text contracts: blank and the controls TAB to CR, nothing else.
WS = r"[\x20\x09-\x0D]"


def once(value: Column) -> Column:
    """value, never copied into what stands above it: filters and projections that use it see a column, not its expression.

    Optimizers move deterministic expressions into filters and lambdas, where a costly one is evaluated again for each
    use or element; the condition here is always true and not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Maximal runs of other characters than WS; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WS + "+"), "")


def bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def carried(docs: DataFrame, keep: list[str] | None = None, **values: Column) -> DataFrame:
    """(row, values...): the columns of docs, or those to keep, as one struct, so that no name of theirs meets an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"), *[v.alias(k) for k, v in values.items()])


def released(rows: DataFrame, **values: Column) -> DataFrame:
    """The columns that were carried, without those that a value replaces, and the values."""
    names = [c for c in rows.schema["row"].dataType.fieldNames() if c not in values]
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[v.alias(k) for k, v in values.items()])


def give_back() -> None:
    """What this process has freed goes back to the system; glibc and Arrow would keep it as long as the process lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives back at a task's end what the task took: it lives on through later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


#: df marked for broadcast if it has at most so many rows, else df as it is.
bounded = small


def numbered(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """df, written, with `number`, its rows' places from 0 in the order, and how many rows there are.

    Rows are dealt by ranges of the order, so that equal keys may lie in several tasks if later ones tell them apart; a
    row's place is its place in its task and the rows of the tasks before. One row a task reaches the driver. df is read
    twice, for the ranges' bounds and for the rows: write what is costly first.
    """
    placed = table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, counts = F.shiftright("_at", 33), []
    total = 0
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        counts.append((r["part"], total - (r["part"] << 33)))
        total += r["n"]
    # One row a task.
    shift = df.sparkSession.createDataFrame(counts, "_part long, _shift long")
    return placed.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn("number", F.col("_at") + F.col("_shift")).drop("_part", "_shift", "_at"), total
