"""Base counts and cutoffs against plain Python."""

import re

import pytest

from tensorloom.llm import quality_rules


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counts(t):
    w, t = words(t), t or ""
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


TEXTS = [None, "", " \n\t ", "word", "a b " * 40, "x y z # $ % & | < > *", "l1 is here\nl2\nl1 is here\n\nl2\nl2 ", " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i % 37}" for i in range(90)), "é😀 " * 30, "w " * 60_000, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + " ".join(f"u{i}" for i in range(40))]


def test_base_counts(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", "src") for i, t in enumerate(TEXTS)] * 2
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string"))
    assert out.columns == ["doc_id", "text", "lang", "source", "quality"] and out.count() == len(rows)
    for r in out.collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == counts(r["text"])
        assert not (q["kept"] and q["base_failed"])


def test_cutoffs_follow_their_group(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(30)), "en", "a") for i in range(250)]
    odd = [(1000, " ".join(f"w%o$r#d&{k}" for k in range(30)), "en", "a"), (1001, " ".join(f"LOUD{k}" for k in range(30)), "en", "a")]
    # A source of nothing but symbols sets its own cutoff; one too small for a sketch of its own takes its language's.
    symbols = [(2000 + i, " ".join(f"w%o$r#d&{(i + k) % 90}" for k in range(30)), "en", "b") for i in range(250)]
    small = [(3000, " ".join(f"w%o$r#d&{k}" for k in range(30)), "en", "c")]
    out = quality_rules.judge(spark.createDataFrame(plain + odd + symbols + small, "doc_id int, text string, lang string, source string"))
    kept = {r["doc_id"]: (r["quality"]["kept"], r["quality"]["failed_features"]) for r in out.collect()}
    assert all(kept[i][0] for i, *_ in plain) and all(kept[i][0] for i, *_ in symbols)
    assert not kept[1000][0] and "symbol_share" in kept[1000][1] and not kept[1001][0] and "upper_share" in kept[1001][1]


def test_half_junk_moves_no_cutoff(spark):
    clean = lambda i: " ".join(f"word{(i * 7 + k) % 90}" for k in range(30))
    rows = [(i, clean(i) if i % 5 > 1 else " ".join(f"w%o$r#d&{(i + k) % 90}" for k in range(30)), "en", "hot" if i % 3 else "b") for i in range(600)]
    kept = {r["doc_id"]: r["quality"]["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert all(kept[i] == (i % 5 > 1) for i in range(600))


def test_group_size_moves_cutoffs_smoothly(spark):
    # Long words in a source of their own: at no size does one row more turn the source's verdict by much.
    high = []
    for n in (1, 5, 19, 20, 21, 60, 199, 200, 201):
        sketch = spark.createDataFrame([("en", "a", "word_length", 4000, 5000), ("en", "b", "word_length", 9000, n)], "lang string, source string, feature string, bin long, n long")
        high.append(quality_rules.cutoffs(sketch).where("source = 'b'").first()["high"])
    assert high == sorted(high) and max(b - a for a, b in zip(high[2:5], high[3:5], strict=False)) < 1500


def test_sketches_merge(spark):
    rows = [(i, " ".join(["ab"] * (20 + i % 50)), "en", f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, t string, lang string, source string")
    whole = quality_rules.sketches(quality_rules.features(df)).groupBy("feature", "bin").sum("n")
    halves = quality_rules.sketches(quality_rules.features(df.where("doc_id < 150"))).union(quality_rules.sketches(quality_rules.features(df.where("doc_id >= 150")))).groupBy("feature", "bin").sum("n")
    assert whole.exceptAll(halves).count() == 0 and whole.count() == halves.count()


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], "doc_id int, text string, lang string, source string, _q int")).collect() == []


def test_clashing_columns(spark):
    names = "row t w n chars sym up dup rep q cut l s failed feature bin low high _lang _q _w".split()
    rows = [(1, "some words " * 12, "en", "a", *names)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names)))
    r = out.first()
    assert out.columns == ["doc_id", "text", "lang", "source", *names, "quality"] and [r[c] for c in names] == names and r["quality"]["n_words"] == 24


@pytest.mark.parametrize("v", [0, 1, 63, 64, 65, 127, 128, 1000, 123456])
def test_bins(spark, v):
    from pyspark.sql import functions as F

    low = spark.range(1).select(quality_rules._bin(F.lit(v).cast("long")).alias("b")).first()["b"]
    assert low <= v < low + max(1, low / 32) + 1e-9 and (v >= 64 or low == v)
