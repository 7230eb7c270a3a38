"""Every stage against a plain version of it over its own input."""

import re

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from tensorloom.llm import queries, sql, toxicity  # noqa: E402

from .test_near_dedup import brute  # noqa: E402
from .test_toxicity import plain_score  # noqa: E402


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(text, items):
    """Whether some window of an item's size shares 80 percent of its weighted shingles, by trying all of them."""
    from collections import Counter

    w = words(text)
    for i in items:
        width = min(5, len(i))
        bag = Counter(tuple(i[k : k + width]) for k in range(len(i) - width + 1))
        for s in range(max(1, len(w) - len(i) + 1)):
            v = w[s : s + len(i)]
            own = Counter(tuple(v[k : k + width]) for k in range(len(v) - width + 1))
            m = sum((bag & own).values())
            if m and 100 * m >= 80 * sum((bag | own).values()):
                return True
    return False


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.schema.names == docs.schema.names
        seen[name] = ({r["doc_id"]: r.asDict() for r in docs.collect()}, {r["doc_id"]: r.asDict() for r in out.collect()})
        docs = spark.createDataFrame(list(seen[name][1].values()), docs.schema) if name != "sentencepiece" else docs
    before, after = seen["quality rules"]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert set(after) == {i for i, k in duckdb.sql(f"WITH {sql.QUALITY_CTES} SELECT doc_id, kept FROM q_judged").fetchall() if k}
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    import zlib

    rows = sorted((i, r["text"]) for i, r in before.items() if i in labels and zlib.crc32(str(i).encode()) % 3 != 1)
    model = toxicity.fit(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert rows and all((plain_score(model, r["text"] or "") < toxicity.THRESHOLD) == (i in after) for i, r in before.items())
    before, after = seen["minhash near-dedup"]
    assert set(after) == {i for i, (_, _, kept) in brute([(i, r["text"]) for i, r in before.items()], 80).items() if kept}
    before, after = seen["benchmark decontamination"]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    short = {i for i, r in before.items() if len(words(r["text"])) <= 600}
    assert {i for i in short if not leaks(before[i]["text"], items)} == short & set(after)
    before, after = seen["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert {i: r["n_tokens"] for i, r in after.items()} == {i: len(sp.encode(r["text"], add_eos=True)) for i, r in before.items()}


def test_run_equals_stages(spark, sf_dir):
    """run() gives the rows of the stages, called one after the other on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame([r.asDict() for r in kept.collect()], kept.schema)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.select(*out.columns).collect())) != []
