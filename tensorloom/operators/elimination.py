"""Rank and solvability mod 2 of large sparse matrices: light pivots are peeled by joins, what is left is eliminated in packed blocks.

A column with one entry gives its row away, a row with one entry its column; each is a pivot and no other entry changes,
apart from right-hand sides. A row with two entries makes two columns one. What no such step shortens is the core. Its rows are packed into words, every task reduces
its own to echelon form, and those forms, which have at most a row a column, are merged four at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .graph import components

#: Columns that a core may have: an echelon form takes this squared over eight bytes, and a task merges four.
MOST_COLUMNS = 20_000
#: Rows that a task reduces at a time beside its echelon form.
BLOCK = 4096
#: Rows of two entries that a task makes a forest of at a time beside the one it has.
LOT = 500_000


def echelon(rows: np.ndarray, columns: int) -> np.ndarray:
    """Echelon form of packed rows; the last word of each is its right-hand sides. Rows that vanish leave one row of the right-hand sides that any of them had."""
    rows, r = rows.copy(), 0
    for c in range(columns):
        if r == len(rows):
            break
        has = (rows[r:, c >> 6] >> np.uint64(c & 63)) & np.uint64(1)
        k = int(has.argmax())
        if not has[k]:
            continue
        if k:
            rows[[r, r + k]] = rows[[r + k, r]]
            has[k] = has[0]
        has[0] = 0
        rows[r + 1 :][has[1:].astype(bool)] ^= rows[r]
        r += 1
    bad = np.bitwise_or.reduce(rows[r:, -1]) if r < len(rows) else np.uint64(0)
    if bad:
        rest = np.zeros((1, rows.shape[1]), dtype=np.uint64)
        rest[0, -1] = bad
        return np.concatenate([rows[:r], rest])
    return rows[:r]


def _core(entries: DataFrame, sides: DataFrame, columns: int) -> tuple[int, int]:
    """Rank, and the right-hand sides that have no solution, of a matrix of so many columns."""
    width = (columns + 63) // 64 + 1
    number = F.row_number().over(W.orderBy("col")) - 1  # at most MOST_COLUMNS rows
    named = entries.join(F.broadcast(entries.select("col").distinct().withColumn("k", number)), "col")
    packed = named.groupBy("row").agg(F.collect_list("k").alias("ks")).join(sides, "row", "left").select("ks", F.coalesce("b", F.lit(0).cast("long")).alias("b"))

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = np.zeros((0, width), dtype=np.uint64)
        for f in frames:
            for at in range(0, len(f), BLOCK):
                part = f.iloc[at : at + BLOCK]
                rows = np.zeros((len(part), width), dtype=np.uint64)
                for i, ks in enumerate(part["ks"]):
                    np.bitwise_xor.at(rows[i], ks >> 6, np.uint64(1) << (ks & 63).astype(np.uint64))
                rows[:, -1] = part["b"].to_numpy().astype(np.int64).view(np.uint64)
                form = echelon(np.concatenate([form, rows]), columns)
        if len(form):
            yield pd.DataFrame({"bits": [r.tobytes() for r in form]})

    forms = packed.mapInPandas(reduced, "bits binary").withColumn("part", F.spark_partition_id())

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(f["bits"]), dtype=np.uint64).reshape(-1, width)
        return pd.DataFrame({"bits": [r.tobytes() for r in echelon(rows, columns)], "part": f["part"].iloc[0]})

    forms = table(forms)
    while (most := forms.agg(F.max("part")).first()[0]) is not None:
        if not most:
            break
        forms = table(forms.withColumn("part", F.floor(F.col("part") / 4).cast("int")).groupBy("part").applyInPandas(merged, "bits binary, part int"))
    # The last word alone has bits in the row of what has no solution.
    empty = F.substring("bits", 1, 8 * (width - 1)) == F.lit(bytes(8 * (width - 1)))
    sides_of = F.conv(F.hex(F.reverse(F.substring("bits", 8 * (width - 1) + 1, 8))), 16, -10).cast("long")
    got = forms.select(empty.alias("empty"), F.when(empty, sides_of).alias("b")).agg(F.count(F.when(~F.col("empty"), 1)), F.bit_or("b")).first()
    return got[0], got[1] or 0


def _added(sides: DataFrame) -> DataFrame:
    return sides.groupBy("row").agg(F.bit_xor("b").alias("b")).where("b <> 0")


def _contracted(m: DataFrame, b: DataFrame, lot: int) -> tuple[DataFrame, DataFrame, int]:
    """m and b with columns replaced by others that a row of two entries makes their equals, and how many are.

    Half of the columns, drawn by lot, may go and the others stay, so that no column is replaced by one that goes, too. Rows grow no longer by it.
    """
    drawn = F.xxhash64("col", F.lit(lot)) % 2 == 0
    two = m.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(drawn, F.col("col"))).alias("col"), F.min(F.when(~drawn, F.col("col"))).alias("to")).where("n = 2 AND col IS NOT NULL AND to IS NOT NULL")
    pivots = table(two.groupBy("col").agg(F.min(F.struct("row", "to")).alias("p")).select("col", F.col("p.row").alias("pivot"), F.col("p.to").alias("to")))
    n = pivots.count()
    if not n:
        return m, b, 0
    rest = m.join(pivots.select(F.col("pivot").alias("row")), "row", "left_anti")
    moved = rest.join(pivots, "col", "left").select("row", F.coalesce("to", "col").alias("col"))
    given = pivots.select("col", "pivot").join(b.withColumnRenamed("row", "pivot"), "pivot")
    taken = rest.join(given, "col").select("row", "b")
    left = moved.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("row", "col")
    return table(left), table(_added(b.join(pivots.select(F.col("pivot").alias("row")), "row", "left_anti").union(taken))), n


def forest(pairs: DataFrame, lot: int = LOT) -> DataFrame:
    """(a, b): links between the same columns as the pairs (a, b) make equal, fewer of them: each task hands on a forest of its own pairs.

    Pairs are dealt by a. A task keeps a link for each column it has seen, beside a lot of pairs at a time. Columns are bigint.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((2, 0), dtype=np.int64)
        waiting: list[np.ndarray] = []
        n = 0
        for batch in batches:
            waiting.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
            n += batch.num_rows
            if n >= max(lot, kept.shape[1]):
                kept, waiting, n = _linked(np.concatenate([kept, *waiting], axis=1)), [], 0
        kept = _linked(np.concatenate([kept, *waiting], axis=1))
        for at in range(0, kept.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(kept[k, at : at + 100_000]) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b").repartition("a").mapInArrow(reduced, "a bigint, b bigint")


def _linked(links: np.ndarray) -> np.ndarray:
    """A link from each column, but the smallest one of each connected set, to that smallest one."""
    names, flat = np.unique(links, return_inverse=True)
    u, w = flat.reshape(2, -1)
    root = np.arange(len(names))
    while len(u):
        a, b = root[u], root[w]
        apart = a != b
        u, w, a, b = u[apart], w[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, again := root[root]):
            root = again
    moved = root != np.arange(len(names))
    return np.stack([names[moved], names[root[moved]]])


def pairs_rank(pairs: DataFrame) -> int:
    """The rank mod 2 of a matrix whose rows have two entries each, in the columns a and b, given without names for its rows.

    Such a row makes two columns one; a set of columns that become one has a pivot for each but the last. Rows whose two
    entries fall on one column are zero, rows with a null are left out.
    """
    links = table(forest(pairs.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    return components(links).where("id <> component").count()


def eliminate(entries: DataFrame, sides: DataFrame | None = None, trace: list[tuple[int, int, int]] | None = None) -> tuple[int, int]:
    """(rank, unsolvable) of the matrix with ones at (row, col) and right-hand sides (row, b), a bit of b for each of up to 64.

    Entries that occur an even number of times are zero; rows with a null anywhere are left out. Bit k of unsolvable is
    set if no choice of columns adds up to side k. trace takes the pivots of each round, by columns, by rows and by pairs. Only
    counts reach the driver. ValueError if the core has more than MOST_COLUMNS columns.
    """
    spark = entries.sparkSession
    m = table(entries.where("row IS NOT NULL AND col IS NOT NULL").groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("row", "col"))
    none = spark.createDataFrame([], f"row {m.schema['row'].dataType.simpleString()}, b bigint")
    b = table(none if sides is None else sides.where("row IS NOT NULL").groupBy("row").agg(F.bit_xor("b").alias("b")).where("b <> 0").select(F.col("row").cast(m.schema["row"].dataType), "b"))
    rank = unsolvable = 0
    seen: list[tuple[int, int, int]] = []
    while True:
        alone = table(m.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where("n = 1").select("row").distinct())
        by_col = alone.count()
        left = m.join(alone, "row", "left_anti")
        pivots = table(left.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("col")).where("n = 1").groupBy("col").agg(F.min("row").alias("row")))
        by_row = pivots.count()
        kept = b.join(alone, "row", "left_anti")
        # A row that loses an entry takes the right-hand sides of the row that had it alone.
        given = pivots.withColumnRenamed("row", "pivot").join(kept.withColumnRenamed("row", "pivot"), "pivot")
        taken = left.join(given, "col").where("row <> pivot").select("row", "b")
        b = table(_added(kept.join(pivots.select("row"), "row", "left_anti").union(taken)))
        m = table(left.join(pivots.select("col"), "col", "left_anti"))
        m, b, by_pair = _contracted(m, b, len(seen))
        rank += by_col + by_row + by_pair
        seen.append((by_col, by_row, by_pair))
        # Pairs are drawn by lot: several rounds without one, not the first, end it.
        if not any(map(sum, seen[-4:])) and len(seen) >= 4 or not (by_col + by_row + by_pair) and not m.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n = 2").limit(1).count():
            break
    if trace is not None:
        trace += seen
    lost = b.join(m.select("row").distinct(), "row", "left_anti").agg(F.bit_or("b")).first()[0]
    columns = m.agg(F.count_distinct("col")).first()[0]
    if columns > MOST_COLUMNS:
        raise ValueError(f"a core of {columns} columns")
    if columns:
        more, unsolvable = _core(m, b, columns)
        rank += more
    return rank, (unsolvable | (lost or 0)) & (1 << 64) - 1


def solvable(entries: DataFrame, sides: DataFrame, targets: list[str]) -> DataFrame:
    """(target, solvable): whether the columns of the matrix add up mod 2 to each right-hand side, bit k of b being that of targets[k]."""
    _, bad = eliminate(entries, sides)
    return entries.sparkSession.createDataFrame([(t, not bad >> k & 1) for k, t in enumerate(targets)], "target string, solvable boolean")
