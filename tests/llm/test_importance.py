"""Weights, noise and ranks against plain Python."""

import hashlib
import math
import re
import zlib

import pytest

from tensorloom.llm import common, importance


def grams(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, percent, least, buckets, longest):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in grams(text, longest)[1]:
            s[b(f)] += 1
    for text in target:
        for f in grams(text, longest)[1]:
            t[b(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b(x)] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def texts(n):
    words = "alpha Beta gamma2 délta ÉTÉ x9 the of 日本 run-on a_b".split()
    return [" ".join(words[(i * j + j * j) % len(words)] for j in range(5 + i % 40)) for i in range(n)]


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (3, 50, 20), (2, 100, 1)])
def test_against_plain(spark, longest, percent, least):
    many = texts(150)
    docs = [(i, t) for i, t in enumerate(many)] + [(1000 + i, many[40]) for i in range(300)] + [(5000, None), (5001, ""), (5002, " \x7f - "), (5003, "word " * 30_000), (None, many[33]), (7, many[7]), (7, many[7])]
    target = [many[3], many[60], None, "", "Delta-alpha 日本"]
    out = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), percent, least, 97, longest)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(docs, target, percent, least, 97, longest)


def test_distinct_texts_are_weighed_once(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 3} of few") for i in range(900)], "doc_id long, text string")
    assert sorted(r["copies"] for r in importance.collapse(docs).collect()) == [300, 300, 300]


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("some words",)], "text string")
    assert importance.resample(none, target).collect() == []
    docs = spark.createDataFrame([(1, "w " * 25)], "doc_id long, text string")
    assert importance.resample(docs, none).first()["rank"] is None and importance.resample(docs, none, percent=100).first()["rank"] == 1


def test_clashing_columns(spark):
    names = "row digest key hot cold known number bucket buckets copies gain s t id _at _part _shift n_features weight score rank".split()
    docs = spark.createDataFrame([(1, "w " * 25, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    r = importance.resample(docs, docs).first()
    assert all(r[c] == c for c in names[:-4]) and r["n_features"] == 25


def test_numbered(spark):
    from pyspark.sql import functions as F

    df = common.table(spark.createDataFrame([(i * 7919 % 500, i % 3) for i in range(2000)], "a int, b int"))
    out, n = common.numbered(df, F.desc("a"), F.asc("b"))
    rows = sorted(out.collect(), key=lambda r: r["number"])
    assert n == 2000 and [r["number"] for r in rows] == list(range(2000)) and [(-r["a"], r["b"]) for r in rows] == sorted((-r["a"], r["b"]) for r in rows)
