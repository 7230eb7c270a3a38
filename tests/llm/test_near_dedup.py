"""Near-duplicate classes against brute force over all pairs."""

import random
import re

import pytest

from tensorloom.llm import near_dedup, queries


def brute(rows, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    post = {}
    for i, s in sets:
        for x in s:
            post.setdefault(x, []).append(i)
    of = dict(sets)
    for a, b in {(a, b) for v in post.values() for a in v for b in v if a < b}:
        n = len(of[a] & of[b])
        if 100 * n >= percent * (len(of[a]) + len(of[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def got(df):
    return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_whole_table(spark, sf_dir, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(near_dedup.near_duplicates(docs, percent=percent)) == brute(rows, percent)


def test_large_group_around_a_lost_or_kept_original(spark):
    """Copies that are near their original and not near each other, more of them than neighbours are looked at."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    other = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    for _ in range(40):
        w = list(other)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)) == brute(rows, 85)


def test_confirmed_pairs_of_a_large_group(spark, monkeypatch):
    """Copies of copies, most pairs of them about as similar as asked: far fewer pairs are confirmed than there are."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    seen = []
    confirm = near_dedup._confirm
    monkeypatch.setattr(near_dedup, "_confirm", lambda pairs, *rest: seen.append(pairs.count()) or confirm(pairs, *rest))
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)) == brute(rows, 85)
    assert 0 < sum(seen) < 20 * len({t for _, t in rows})


def test_nulls_empty_short_and_repeated(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "A b", 0), (5, "a B", 0), (6, "a b c", 0), (5, "a B", 0), (None, "a b", 0), (7, "long " * 4000, 0)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long"), percent=85).collect()
    seen = sorted((r["id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert seen == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True)]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert kept.columns == ["doc_id", "text", "n"] and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_clashing_columns(spark):
    names = "id n fp sig row key r a b component kept _kept n_shingles tree".split()
    df = spark.createDataFrame([(1, "a b c d e f", *names), (2, "a b c d e f", *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns and [list(r) for r in out.collect()] == [[1, "a b c d e f", *names]]


def test_query_columns(spark, sf_dir):
    assert queries.op5_minhash_near_dedup(spark, sf_dir).columns == ["doc_id", "n_shingles", "component_id", "kept"]
