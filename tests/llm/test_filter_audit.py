"""Flags and every order's steps against plain Python."""

import itertools
import re

from tensorloom.llm import filter_audit


def plain_flags(docs):
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def plain(docs, labels):
    fails, rows = plain_flags(docs), []
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if (s or "") == part]
        removed_in = {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                out = [(i, x) for i, x in left if f in x]
                removed_in[f] = removed_in.get(f, 0) + len(out)
                before = len([1 for i, x in mine if f in x]) - len(out)
                left = [(i, x) for i, x in left if f not in x]
                rows.append([part, "".join(order), k + 1, len(left), len(out), before, sum(x == {f} for _, x in mine), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), f])
        for r in rows:
            if r[0] == part:
                r[9] = removed_in[r[9]] if isinstance(r[9], str) else r[9]
    return sorted(map(tuple, rows))


def made():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \n", "short", long, long + " #", "UPPER " + "AB " * 220, "rep eat " * 200, long, long, "short", "x " * 50_000, long.upper(), "é\x0b😀 $"]
    docs = [(i, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts)]
    docs += [(4, long, "a"), (4, long, "a"), (4, "another text", "a"), (None, long, "b"), (None, "", None)] + [(100 + i, "copied text", "hot") for i in range(200)]
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 300, 3)] + [(4, 0, 1), (4, 1, None), (None, 1, 1)]
    return docs, labels


def test_flags(spark):
    docs, _ = made()
    got = filter_audit.flags(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    want = sorted(((i, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sum(1 << "ABCDE".index(x) for x in f)) for (i, t, s), f in zip(docs, plain_flags(docs), strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["part"], r["n_words"], r["mask"]) for r in got.collect()), key=repr) == want


def test_against_plain(spark):
    docs, labels = made()
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.MEASURES]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, labels)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    assert filter_audit.audit(one, labels).count() == 600


def test_clashing_columns(spark):
    names = "h w n part digest own first mask copies total n_words n_distinct is_good is_toxic f before _id _h".split()
    docs = spark.createDataFrame([(1, "a b", "s", *names)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([(1, 1, 0, *names)], "doc_id long, quality int, toxic int, " + ", ".join(f"{c} string" for c in names))
    assert filter_audit.audit(docs, labels).where("filter_order = 'ABCDE' AND step = 1").first()["good_lost"] == 1
