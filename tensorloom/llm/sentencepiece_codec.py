"""SentencePiece encoding and decoding with a table of distinct chunks.

A model none of whose pieces has a whitespace marker after another character never merges across the start of a
marked word. Each task then segments every distinct marked word once, keeps its ids in a table of bounded size and
joins them back by position; the ids equal those of the library on the whole text. Models with pieces that do cross,
or that rewrite text before they segment it, are applied to whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

MARK = "▁"
#: Entries of a task's table; a full one is dropped and filled anew, which changes no result.
TABLE_ENTRIES = 100_000
#: Characters of text that are turned into one Arrow batch of ids at most, unless one text is longer.
BATCH_CHARS = 1_000_000
#: The same while encoding, where each word and id is a Python object.
PIECE_CHARS = 250_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkEncoder:
    """encode(texts) as the library gives it, from a table of distinct marked words."""

    def __init__(self, model_path: str, end_id: bool = True, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end, self.entries, self.known = [self.sp.eos_id()] if end_id else [], entries, {}
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        same = self.sp.encode("  a ﬁ  ", out_type=str)
        self.chunks = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.decode(self.sp.encode("  a ﬁ  ")) == "  a ﬁ  " and "".join(same).startswith(MARK * 3)
        self.alone = self.sp.piece_to_id(MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.chunks:
            return [ids + self.end for ids in self.sp.encode(texts, num_threads=1)]
        parts = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known, distinct = self.known, dict.fromkeys(chain.from_iterable(parts))
        new = [c for c in distinct if c not in known]
        if len(known) + len(new) > self.entries:
            known.clear()
            new = list(distinct)
        # The library puts a marker before what it is given, hence without the chunk's first one.
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            known.update((c, array("i", ids).tobytes()) for c, ids in zip(some, self.sp.encode([c[1:] for c in some], num_threads=1), strict=True))
        if MARK in distinct:
            known[MARK] = array("i", [self.alone]).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32).tolist() + self.end for p in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([f for f in schema if f.name not in {x.name for x in fields}] + list(fields))


def _pieces(batch: pa.RecordBatch, column: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many characters."""
    start, n = 0, 0
    for i, x in enumerate(batch.column(column)):
        n += len(x.as_py() or "")
        if n >= chars:
            yield batch.slice(start, i + 1 - start)
            start, n = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", end_id: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs with `ids` (array<int>: the whole text's ids, the end id last) and `decoded` (string: the library's decode of ids).

    A null text counts as empty: the end id alone, decoded to "". Repeated rows, extra columns and empty tables pass
    through; columns already named ids or decoded are replaced. keep: the columns of docs that are wanted, all if None.
    Needs model_path on each machine.
    """
    schema = _with(T.StructType([f for f in docs.schema if keep is None or f.name in keep]), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False))
    kept = [f.name for f in schema][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for whole in batches:
            coder = coder or ChunkEncoder(model_path, end_id)
            at = whole.schema.get_field_index(text)
            for b in _pieces(whole, at, PIECE_CHARS):
                ids = coder.encode([t or "" for t in b.column(at).to_pylist()])
                decoded = coder.decode(ids)
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in kept], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.mapInArrow(lean(run), schema)
