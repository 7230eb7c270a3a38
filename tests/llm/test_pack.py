"""Ids as the library gives them, cuts, patterns that fill sequences, and packings that hold every token once."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from tensorloom.llm import pack, queries  # noqa: E402

JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "word", "A  b\n\n c\t", "it's 12,345 €uro", "<|endoftext|> in a text", "日本語 😀", "x" * 5000, "word " * 3000, "\x00\x01", " " * 3000, "\n" * 1025]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(JSON)


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_ids_equal_the_library(library, ranks):
    coder = pack.Encoder(JSON, ranks, public.PATTERN)
    for t in TEXTS:
        assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_ids_of_every_code_point(library):
    coder = pack.Encoder(JSON, RANKS, public.PATTERN)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c} {c}1 !{c}  {c}" for c in chars[k : k + 64]) for k in range(0, len(chars), 64)]
    assert all(coder.encode(t).tolist() == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))


def test_cuts():
    assert pack.cut(1024, 1024) == [(0, 1024)] and pack.cut(1, 1024) == [(0, 1)]
    assert pack.cut(1025, 1024) == [(0, 1), (1, 1024)] and pack.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert pack.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_patterns_are_all_pairs_and_triples():
    h = np.array([0, 3, 0, 2, 1, 5, 0, 1, 9])
    size, present = 8, [1, 3, 4, 5, 7]
    want = {(a, b, 0) for a in present for b in present if a >= b and a + b == size} | {(a, b, c) for a in present for b in present for c in present if a >= b >= c and a + b + c == size}
    assert {tuple(p) for p in pack.patterns(h).tolist()} == want


def test_fit_is_the_least_squares_solution():
    h = np.zeros(101, dtype=np.int64)
    h[[70, 30, 50, 20, 60]] = [40, 60, 35, 20, 0]
    columns = pack.patterns(h)
    x = pack.fit(h, columns)
    # 70 + 30, 50 + 50, 50 + 30 + 20: fits 40, 15 and 20, then 50: 15 + 15 ... all lengths but the surplus vanish.
    got = np.bincount(columns.ravel(), np.repeat(x, 3), minlength=101)[1:]
    assert (x >= 0).all()
    w = np.arange(1, 101) / 100
    error = (w * (got - h[1:]) ** 2).sum()
    rng = np.random.default_rng(1)
    for _ in range(300):
        y = np.maximum(0, x + rng.normal(0, 1, len(x)))
        other = np.bincount(columns.ravel(), np.repeat(y, 3), minlength=101)[1:]
        assert (w * (other - h[1:]) ** 2).sum() >= error - 1e-6


def held(plan, size):
    h = np.zeros(size + 1, dtype=np.int64)
    for pattern, many in plan:
        assert many > 0 and sum(l * k for l, k in pattern) <= size
        for l, k in pattern:
            h[l] += k * many
    return h


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    size = 128
    h = rng.poisson(rng.choice([0.2, 3, 500], size + 1)) * (rng.random(size + 1) < rng.choice([0.1, 0.9]))
    h[0] = 0
    plan = pack.plan(h)
    n, least = sum(m for _, m in plan), -(-(h * np.arange(size + 1)).sum() // size)
    assert (held(plan, size) == h).all() and n >= least
    # Best fit, one piece at a time, is no better by more than a hundredth.
    room = []
    if h.sum() < 20000:
        for l in range(size, 0, -1):
            for _ in range(h[l]):
                fits = [r for r in room if r >= l]
                if fits:
                    room.remove(min(fits))
                    room.append(min(fits) - l)
                else:
                    room.append(size - l)
        assert n <= len(room) * 1.01 + 1


def test_patterns_beat_best_fit_where_they_fit():
    # Thirds and halves: best fit puts 7 with 3 and leaves rests; the patterns fill every sequence.
    h = np.zeros(11, dtype=np.int64)
    h[[5, 4, 3, 2]] = [1000, 1000, 1000, 500]
    # 5 + 5, 4 + 4 + 2, 4 + 3 + 3 ...
    assert sum(m for _, m in pack.plan(h)) <= sum(m for _, m in pack.residual(h))
    assert pack.plan(np.zeros(11, dtype=np.int64)) == []


def check(rows, size):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        parts.sort()
        end = 0
        for offset, length in parts:
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packed_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS])] + [(3, "word", "x"), (3, "word", "x"), (None, "no id", "x")] + [(100 + i, "same text " * (1 + i % 7), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, number string")
    out = pack.pack(df, JSON, RANKS, public.PATTERN, size=64)
    assert out.columns == ["doc_id", "number", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = out.collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        starts = [0, *range(first, len(ids), 64)] if len(ids) > 64 else [0]
        for k, a in enumerate(starts):
            part = ids[a : starts[k + 1] if k + 1 < len(starts) else None]
            want.append((i, k, a, len(part), part))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=repr) == sorted(want, key=repr)
    n = check(got, 64)
    assert n <= sum(w[3] for w in want) / 64 * 1.05 + 1
    whole = pack.sequences(out).collect()
    assert len(whole) == n and sum(len(r["ids"]) for r in whole) == 4 * sum(w[3] for w in want)
    by = {(r["sequence_id"], r["offset"]): r["ids"] for r in got}
    assert all(bytes(r["ids"][4 * o : 4 * o + len(x)]) == bytes(x) for r in whole for (s, o), x in by.items() if s == r["sequence_id"])


def test_one_length_is_dealt_over_tasks(spark):
    cut = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(700).cast("long").alias("length"))
    placed = pack.place(cut, ties=["doc_id"])
    assert placed.agg(F.count_distinct("sequence_id")).first()[0] == 20_000 and placed.where("offset <> 0").count() == 0


def test_empty_table(spark):
    out = pack.pack(spark.createDataFrame([], "doc_id long, text string"), JSON, RANKS, public.PATTERN)
    assert out.count() == 0


def test_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_best_fit_packing(spark, sf_dir).collect()
    check(rows, 1024)
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
    assert set(seen) == set(docs)
    for i, parts in seen.items():
        ids = np.array(library.encode(docs[i] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        parts.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(ids)
        for p in parts:
            assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["length"] == 1024 or p["piece"] == 0
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 1024) + 2
