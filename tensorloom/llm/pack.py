"""Packing documents into sequences of a fixed length by patterns of few documents, fitted by non-negative least squares.

Documents become token ids and pieces of at most `size` tokens; the histogram of the pieces' lengths has at most `size`
entries, whatever the corpus. Patterns of two and three lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram without negative ones and rounded down, and what is left goes into the fullest sequence
that has room, longest first, a length at a time. Pieces then take the places of their length in order.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, numbered, released, table

#: The id that ends each document.
END_ID = 2
#: Characters that a worker encodes at a time, at least one text.
BATCH_CHARS = 1 << 20
#: Powers of a length's share of the size by which its misfit weighs.
POWERS = (0.5, 2.0)
Pattern = tuple[tuple[int, int], ...]


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary.

    The same vocabulary as ranks gives the same ids several times faster (tests compare them for every code point); texts
    that name a special token, and any that the fast one refuses, go to the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None) -> None:
        self.json_path, self._whole, self.fast = json_path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if ranks_path:
            self._whole = None

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return self._whole

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of the full size but the first, if it doesn't come out even."""
    first = length % size or size
    return [(0, first), *((at, size) for at in range(first, length, size))] if length > size else [(0, length)]


def _batches(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    start, n = 0, 0
    for i, x in enumerate(batch.column(at)):
        n += len(x.as_py() or "")
        if n >= BATCH_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, n = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 1024, end_id: int = END_ID, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, piece, start, length, ids) of each piece of each text, ids as little-endian unsigned 32-bit numbers.

    keep names the columns to repeat beside each piece, all but text by default. A null text counts as empty: one piece
    of the end id alone. Repeated rows have pieces of their own; an empty table has none; columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c != "text"] if keep is None else keep
    rows = carried(docs, kept, text=F.col("text"))
    out = T.StructType([rows.schema["row"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or Encoder(json_path, ranks_path, pattern)
            for b in _batches(whole, 1):
                from_row, number, start, length, ids = [], [], [], [], []
                for i, text in enumerate(b.column(1)):
                    coded = np.append(encoder.encode(text.as_py() or ""), end_id).astype("<u4")
                    for k, (at, n) in enumerate(cut(len(coded), size)):
                        from_row.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(n)
                        ids.append(coded[at : at + n].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(from_row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=out.names)

    return released(rows.mapInArrow(run, out), **{c: F.col(c) for c in out.names[1:]})


def patterns(histogram: np.ndarray) -> np.ndarray:
    """(m, 3): the pairs and triples of lengths that occur and add up to the size, falling; a pair's third length is 0. histogram[l] counts the pieces of length l, its last index is the size."""
    size = len(histogram) - 1
    present = np.flatnonzero(histogram[1:size]) + 1
    a, b = np.meshgrid(present, present, indexing="ij")
    c = size - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[fits], b[fits], c[fits]
    found = (c == 0) | (histogram[c] > 0)
    return np.stack([a[found], b[found], c[found]], axis=1)


def fit(histogram: np.ndarray, columns: np.ndarray, power: float = 0.5, rounds: int = 60, block: int = 128, close: float = 2e-5) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, least squares against the histogram, by an active set that grows by blocks.

    Each round adds patterns that would lessen the error, solves, and drops those that get no positive count until all
    have one, at most as many as there are lengths; it ends at a misfit of the share `close` of all tokens. A length weighs
    by a power of its share of the size, as short pieces find room anywhere.
    """
    size, m = len(histogram) - 1, len(columns)
    x = np.zeros(m)
    if not m:
        return x
    weight = (np.arange(size + 1) / size) ** power
    weight[0] = 0
    scale = histogram[1:size].max()
    goal = weight * histogram / scale
    goal[size] = 0

    def matrix(which: np.ndarray) -> np.ndarray:
        out = np.zeros((size + 1, len(which)))
        np.add.at(out, (columns[which], np.arange(len(which))[:, None]), 1.0)
        return out * weight[:, None]

    best, error = x.copy(), np.inf
    for _ in range(rounds):
        rest = goal - weight * np.bincount(columns.ravel(), np.repeat(x, 3), minlength=size + 1)
        if (now := (weight * np.abs(rest)).sum()) < error:
            best, error = x.copy(), now
        if error <= close * (weight * goal).sum():
            break
        pull = (weight * rest)[columns].sum(axis=1)
        pull[x > 0] = 0
        # The strongest patterns that share no length, so that one does not answer the others' pull.
        used, new = np.zeros(size + 1, dtype=bool), []
        for j in np.argsort(-pull, kind="stable")[: 16 * block]:
            if pull[j] <= 1e-9 or len(new) == block:
                break
            lengths = columns[j][columns[j] > 0]
            if not used[lengths].any():
                used[lengths] = True
                new.append(j)
        if not new:
            break
        which = np.concatenate([np.flatnonzero(x), new])
        while len(which):
            a = matrix(which)
            solved = np.linalg.solve(a.T @ a + 1e-10 * np.eye(len(which)), a.T @ goal)
            if (solved > 0).all():
                break
            which = which[solved > 0]
        x[:] = 0
        if len(which):
            x[which] = solved
    return best * scale


def rounded(histogram: np.ndarray, columns: np.ndarray, x: np.ndarray, nearest: bool) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Whole repeat counts, rounded down or to the nearest, none beyond what the histogram has left, largest first; and what is left."""
    left, out = histogram.copy(), []
    for up in (False, True)[: 1 + nearest]:
        for j in np.argsort(-x, kind="stable"):
            taken = int(x[j]) if not up else int(x[j] % 1 >= 0.5)
            need = defaultdict(int)
            for l in columns[j].tolist():
                if l:
                    need[l] += 1
            taken = min([taken, *(int(left[l]) // k for l, k in need.items())])
            if taken > 0:
                for l, k in need.items():
                    left[l] -= taken * k
                out.append((tuple(sorted(need.items(), reverse=True)), taken))
    return out, left


def residual(left: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over counts: equal sequences are filled together, so the work grows with the lengths, not with the pieces."""
    size = len(left) - 1
    # By room left: [pattern, how many].
    bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for l in range(size, 0, -1):
        todo = int(left[l])
        while todo:
            room = next((r for r in range(l, size) if bins.get(r)), size)
            filled, many = bins[room].pop() if room < size else ((), todo)
            each = min(room // l, todo)
            full = min(many, todo // each)
            if room < size and many > full:
                bins[room].append((filled, many - full))
            bins[room - each * l].append(((*filled, (l, each)), full))
            todo -= full * each
    return [x for r in sorted(bins) for x in bins[r]]


def plan(histogram: np.ndarray) -> list[tuple[Pattern, int]]:
    """(pattern, how many sequences have it): a pattern is lengths, falling, and how often each occurs. Together they hold the histogram.

    Least squares doesn't see which misfit costs a sequence; so the fit is made under each of POWERS, rounded both ways, and the
    one with the fewest sequences is taken, the first if it is within a ten-thousandth of what no packing can beat.
    """
    size = len(histogram) - 1
    left = histogram.copy()
    left[0] = left[size] = 0
    columns, best = patterns(left), []
    least = max(-(-int((left * np.arange(size + 1)).sum()) // size), int(left[size // 2 + 1 :].sum()))
    count = lambda found: sum(many for _, many in found)
    for power in POWERS:
        x = fit(left, columns, power)
        for nearest in (False, True):
            fitted, rest = rounded(left, columns, x, nearest)
            found = fitted + residual(rest)
            best = found if not best or count(found) < count(best) else best
        if count(best) <= least * 1.0001:
            break
    return ([(((size, 1),), int(histogram[size]))] if histogram[size] else []) + best


def place(cut_pieces: DataFrame, size: int = 1024, ties: list[str] | None = None) -> DataFrame:
    """cut_pieces (length, from 1 to size) with sequence_id and offset: gapless sequences from offset 0, none beyond the size.

    The driver holds the histogram and the patterns, whose number is bounded by the size and not by the rows. Rows are
    numbered by length and then by the columns ties, which should tell pieces of one length apart, so that a length that
    most pieces have is dealt over many tasks. cut_pieces is read twice: write it first.
    """
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a length
        histogram[r["length"]] = r["n"]
    slots, sequence = [], 0
    for pattern, many in plan(histogram):
        offset = 0
        for length, times in pattern:
            slots.append((length, times, sequence, offset, many * times))
            offset += length * times
        sequence += many
    slots.sort()
    fixed = np.array(slots, dtype=np.int64).reshape(-1, 5)
    first = np.concatenate([[0], np.cumsum(fixed[:, 4])[:-1]]).astype(np.int64)
    rows = carried(cut_pieces, None, length=F.col("length"), **{f"tie{k}": F.col(c) for k, c in enumerate(ties or [])})
    ordered, _ = numbered(rows, F.asc("length"), *[F.asc(f"tie{k}") for k in range(len(ties or []))])

    @F.pandas_udf("sequence_id long, offset long")
    def at(number: pd.Series) -> pd.DataFrame:
        number = number.to_numpy()
        k = np.searchsorted(first, number, side="right") - 1
        length, times, sequence, offset = fixed[k, :4].T
        nth = number - first[k]
        return pd.DataFrame({"sequence_id": sequence + nth // times, "offset": offset + nth % times * length})

    return released(ordered.withColumn("at", at("number")), sequence_id=F.col("at.sequence_id"), offset=F.col("at.offset"))


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 1024, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Pieces of docs with their ids, their sequence and their place in it."""
    return place(table(pieces(docs, json_path, ranks_path, pattern, size, keep=keep)), size, [key, "piece"])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): whole sequences, the ids of their pieces one after the other as little-endian 32-bit numbers; at most size tokens each."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.col("parts.length").alias("lengths"))
