"""The chunk table gives the library's ids, and ids decode to the text."""

import hashlib
import tracemalloc

import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from tensorloom.llm import common, queries  # noqa: E402
from tensorloom.llm.sentencepiece_codec import ChunkEncoder, encode_decode  # noqa: E402

TEXTS = ["", " ", "  a b", "a\nb", "▁x y", "a\x00b", "ﬁ é 日本語", "</s> <s> <unk>", "a\t\tb  ", "\n", "x" * 5000, "Las ciónes  de la ñ 😀😀 ", "a " * 3000, "word word word"]


@pytest.mark.parametrize("entries", [400_000, 3])
def test_ids_equal_the_library(entries):
    model = queries.piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    coder = ChunkEncoder(model, entries=entries)
    assert coder.chunks
    for _ in range(2):
        assert coder.encode(TEXTS) == [sp.encode(t, add_eos=True) for t in TEXTS]
    assert coder.decode(coder.encode(TEXTS)) == [sp.decode(sp.encode(t, add_eos=True)) for t in TEXTS]


def test_nulls_extra_columns_and_empty_table(spark):
    rows = [(1, None, "keep", 5), (1, "a b", "twice", 6), (1, "a b", "twice", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, extra int")
    out = encode_decode(df, queries.piece_model())
    assert out.columns == ["doc_id", "text", "extra", "ids", "decoded"]
    got = sorted((r["text"] or "", r["ids"], r["decoded"]) for r in out.collect())
    assert got[0] == ("", [2], "") and got[1] == got[2] and got[1][2] == "a b"
    assert encode_decode(df.limit(0), queries.piece_model()).collect() == []


def test_only_wanted_columns_leave_python(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a b", 6)], "doc_id long, text string, extra int")
    out = encode_decode(df, queries.piece_model(), keep=["doc_id"])
    assert out.columns == ["doc_id", "ids", "decoded"]
    whole = encode_decode(df, queries.piece_model()).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect())) != []


def test_a_word_takes_few_bytes():
    """What a worker holds is bounded by the table, and an entry is a word and its ids in four bytes each."""
    coder = ChunkEncoder(queries.piece_model())
    texts = [" ".join(f"w{i:07d}" for i in range(k, k + 1000)) for k in range(0, 120_000, 1000)]
    tracemalloc.start()
    try:
        for k in range(0, len(texts), 20):
            coder.encode(texts[k : k + 20])
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 24_000_000
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert coder.encode(texts[:2] + texts[-2:]) == [sp.encode(t, add_eos=True) for t in texts[:2] + texts[-2:]]


def test_a_task_gives_back_what_it_took(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["n"])

    def broken(batches):
        yield next(batches)
        raise ValueError

    assert list(common.lean(lambda batches: batches)(iter([batch, batch]))) == [batch, batch] and given == [1]
    with pytest.raises(ValueError):
        list(common.lean(broken)(iter([batch])))
    assert given == [1, 1]


def test_digest_of_whole_table(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
