"""Leaks against trying every window."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tensorloom.llm import decontaminate


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    found = {}
    for i, t in docs:
        w = words(t)
        for k, it in items:
            q = words(it)
            if not q:
                continue
            width = min(5, len(q))
            bag = Counter(tuple(q[x : x + width]) for x in range(len(q) - width + 1))
            for s in range(max(1, len(w) - len(q) + 1)):
                v = w[s : s + len(q)]
                own = Counter(tuple(v[x : x + width]) for x in range(len(v) - width + 1))
                m, total = sum((bag & own).values()), sum((bag | own).values())
                if m and 100 * m >= 80 * total:
                    found[i, k] = max(found.get((i, k), 0), m / total)
    return found


def test_edited_and_moved_passages(spark):
    rng = random.Random(4)
    vocab = [f"t{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([15, 30, 30, 44, 60, 5, 3, 1])]
    items += [(90, None), (91, ""), (92, "rare same rare same rare same rare same rare same")]
    docs = [(1, None), (2, ""), (3, "t1"), (4, items[2][1]), (5, items[6][1].upper() + " " + items[7][1])]
    for n in range(60):
        w = [rng.choice(vocab) + "x" for _ in range(rng.randrange(0, 150))]
        q = words(rng.choice(items[:7])[1])
        for _ in range(rng.randrange(0, 4)):
            edit = rng.randrange(3)
            at = rng.randrange(len(q))
            q = q[:at] + q[at + 1 :] if edit == 0 and len(q) > 1 else q[:at] + ["new"] + q[at + (edit == 1) :]
        if rng.random() < 0.3:
            h = len(q) // 2
            q = q[h:] + q[:h]
        at = rng.randrange(len(w) + 1)
        docs.append((10 + n, " ".join(w[:at] + q + w[at:])))
    docs.append((99, "x " * 30_000 + items[3][1]))
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["_id"], r["item"]): r["similarity"] for r in got.collect()} == brute(docs, items)


def test_mark_keeps_every_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 0), (1, "a b c d e f g", 0), (2, None, 0), (None, "a b c d e f g", 0), (3, "z", 0)], "doc_id long, text string, leak int")
    items = spark.createDataFrame([(7, "A b c d e f G"), (8, "a b c d e f g")], "item_id long, text string")
    out = decontaminate.mark(docs, items)
    assert out.columns == ["doc_id", "text", "leak"]
    assert sorted((str(r["doc_id"]), r["leak"]["contaminated"], r["leak"]["item_ids"]) for r in out.collect()) == [("1", True, [7, 8]), ("1", True, [7, 8]), ("2", False, []), ("3", False, []), ("None", True, [7, 8])]
    assert decontaminate.mark(docs, items.limit(0)).where("leak.contaminated").count() == 0
    assert decontaminate.mark(docs.limit(0), items).collect() == []


def test_repeats_behind_a_long_passage(spark):
    # A passage cut near its end and followed by a run of one word: the window's repeated shingle must not outweigh the rest.
    rng = random.Random(8)
    items = [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(404))) for k in range(12)]
    docs = [(k, " ".join(words(t)[:360]) + " *" * 44) for k, t in items]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["_id"], r["item"]): r["similarity"] for r in got.collect()}
    assert len(found) == 12 and found == brute(docs, items)


def test_numbered_bag(spark):
    bags = [[3, 3, 5, 3], [5, 3, 3, 3], [3, 3, 5], [], [5]]
    out = [r[0] for r in spark.createDataFrame([(b,) for b in bags], "h array<bigint>").select(decontaminate._numbered(F.col("h"))).collect()]
    assert [len(set(x)) for x in out] == [4, 4, 3, 0, 1] and set(out[0]) == set(out[1]) > set(out[2]) > set(out[4])


def test_near_blocks_are_entered(spark):
    # Fingerprints that differ in RADIUS bits, dealt over the blocks in any way, meet in some block.
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(63)
        b = a
        for k in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << k
        rows.append((a, b - (1 << 64) if b >= 1 << 63 else b))
    df = spark.createDataFrame(rows, "a bigint, b bigint").select(decontaminate._blocks(F.col("a")).alias("x"), decontaminate._entries(F.col("b")).alias("y"))
    assert df.where(F.arrays_overlap("x", "y")).count() == 200 and df.first()["y"].__len__() == 8 * 37


def test_clashing_columns(spark):
    names = "row id key similarity items _id _h _i _hash item words start bag fp".split()
    rows = [(1, "a b c d e f g h i j", *names), (2, "z", *names)]
    out = decontaminate.mark(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)), spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", *names, "leak"]
    assert all([r[c] for c in names] == names and r["leak"]["contaminated"] == (r["doc_id"] == 1) for r in out.collect())


def test_long_items_take_time_in_proportion(spark):
    text = " ".join(f"w{k % 9000}" for k in range(20_000))
    began = time.monotonic()
    got = decontaminate.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, text)], "item_id long, text string")).collect()
    assert [(r["item"], r["similarity"]) for r in got] == [(5, 1.0)] and time.monotonic() - began < 60
