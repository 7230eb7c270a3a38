"""Kernel, machine and held-out accuracy."""

import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tensorloom.llm import queries, toxicity


def plain_kernel(a, b):
    def phi(w):
        out = Counter({("whole", w): toxicity.WHOLE})
        w = f"\x02{w}\x03"
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_is_the_plain_one():
    words = ["idiot", "idxiot", "banana", "anabana", "worthless", "mississippi"]
    m, _ = toxicity.letters(words)
    ids, weights = toxicity.subsequences(m)
    k = toxicity._against(ids, weights, toxicity.norms(ids, weights), list(range(len(words))))
    assert np.allclose(k, [[plain_kernel(a, b) for b in words] for a in words], atol=1e-5)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["the", "re", "on", "ti", "an", "sh", "ou", "ea"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(60)] = rng.choice(["blockhead", "dimwit", "grumblesnork"]) + rng.choice(["", "s", "er"])
        rows.append((i, ". ".join(" ".join(text[k : k + 10]) for k in range(0, 60, 10)), int(toxic)))
    return rows


def test_held_out_gapped_and_spaced():
    model = toxicity.train([(t, y) for _, t, y in corpus(400)])
    p = lambda t: toxicity.probabilities(model, [t])[0]
    seen = [(p(t) >= toxicity.THRESHOLD) == bool(y) for _, t, y in corpus(120, seed=9)]
    assert sum(seen) / len(seen) > 0.97
    for t in ("you blockxhead", "you b l o c k h e a d !", "a block-head", "dimwwit", "grumblesnorkish"):
        assert p(t) > 0.5, t
    assert p("there on anti shou") < 0.1 and p("") < 0.3


def test_score_keeps_rows_and_nulls(spark):
    model = toxicity.train([(t, y) for _, t, y in corpus(200)])
    rows = [(1, None, 9), (2, "", 9), (3, "you dimwit. fine", 9), (3, "you dimwit. fine", 9), (4, "there on " * 20_000, 9)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id int, text string, toxicity int"), model)
    assert out.columns == ["doc_id", "text", "toxicity"] and out.count() == 5
    got = {r["doc_id"]: r["toxicity"] for r in out.collect()}
    assert got[3]["score"] > 0.7 and got[3]["sentence"] == "you dimwit." and got[1]["score"] == got[2]["score"] < 0.5 and got[4]["score"] < 0.5
    assert toxicity.score(spark.createDataFrame([], "doc_id int, text string"), model).collect() == []


def test_one_label_only(spark):
    model = toxicity.train([("fine words", 0)] * 3)
    assert toxicity.probabilities(model, ["anything"])[0] == pytest.approx(0.2)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).bias == 0.0


def test_wrong_labels():
    """One clean text in twenty holds an insult, as a quotation or by a wrong label."""
    rng = random.Random(11)
    rows = [(t, int(not y) if rng.random() < 0.05 else y) for _, t, y in corpus(500)]
    model = toxicity.train(rows)
    p = lambda t: toxicity.probabilities(model, [t])[0]
    seen = [(p(t) >= toxicity.THRESHOLD) == bool(y) for _, t, y in corpus(120, seed=9)]
    assert sum(seen) / len(seen) > 0.95


@pytest.mark.parametrize(("insult", "clean"), [("大笨蛋", "北京大学图书馆"), ("바보", "도서관에서"), ("xq", "no")])
def test_other_scripts_and_short_words(insult, clean):
    rng = random.Random(2)
    letters = "中国人民经济发展社会工作生活学习时间问题" if insult > "\u3000" else "aeioustrlnm"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 6)))
    rows = []
    for i in range(240):
        text = [word() for _ in range(20)] + [clean]
        if i % 3 == 0:
            text[rng.randrange(20)] = insult
        rows.append((" ".join(text), int(i % 3 == 0)))
    model = toxicity.train(rows)
    p = lambda t: toxicity.probabilities(model, [t])[0]
    assert p(insult) > toxicity.THRESHOLD > 0.5 > p(clean)


@pytest.mark.parametrize("text", ["_" * 10**6, "." * 10**6, " " * 10**6, "a." * 10**5, "a.\n" * 10**5, "a _" * 10**5, "_ " * 10**5 + "!", "- " * 10**5 + "a" * 10**5])
def test_hostile_texts_are_read_once(text):
    began = time.monotonic()
    toxicity.tokens(text)
    toxicity.worst_sentence(text, "word")
    assert time.monotonic() - began < 3


def plain_margin(model, weight, w):
    """A word's margin by its definition: each window's subsequences one after the other, and the whole word."""
    w = "".join(c for c in w if c.isalpha())
    w = f"\x02{w}\x03" if w else w
    best, step = model.bias, toxicity.REACH // 2
    for at in range(0, max(1, len(w) - step), step) if len(w) > toxicity.REACH else (0,):
        part, found = [ord(c) for c in w[at : at + toxicity.REACH]], Counter()
        if 0 < len(w) <= toxicity.REACH:
            found[max(1, zlib.crc32(w.encode()) >> 11)] += toxicity.WHOLE
        for i in range(len(part)):
            for j in range(i + 1, len(part)):
                for k in range(j + 1, min(len(part), i + toxicity.SPAN)):
                    x = (part[i] * 0x9E3779B1 + part[j] * 0x85EBCA77 + part[k] * 0xC2B2AE3D) % 2**32
                    x = (x ^ (x >> 15)) * 0x2C1B3C6D % 2**32
                    found[max(1, x >> 11)] += toxicity.DECAY ** (k - i - 2)
        dot = sum(v * weight.get(x, 0.0) for x, v in found.items())
        if dot > 0:
            best = max(best, model.bias + dot / sum(v * v for v in found.values()) ** 0.5)
    return best


def plain_score(model, text):
    """The score by its definition."""
    weight = dict(zip(model.keys.tolist(), model.values.tolist(), strict=True))
    known = {w: plain_margin(model, weight, w) for w in set(toxicity.tokens(text))}
    parts = toxicity.sentences(text)
    beyond = sum(min(1.0, max(0.0, known[w])) for s in parts for w in s)
    worst = min(max(max(known.values(), default=model.bias), -1.0), toxicity.FIRM)
    a, b, c, d = model.scale
    return 1 / (1 + math.exp(-(a * worst + b * math.log1p(beyond) + c * min(1.0, beyond / max(1, len(parts))) ** 0.5 + d)))


def test_stems_in_clean_texts():
    """Insults are a stem with an ending; clean texts hold the bare stem and, seldom, one of the insults."""
    rng = random.Random(3)
    sound = ["ba", "lo", "mi", "ten", "sur", "ak", "el", "po"]
    word = lambda: "".join(rng.choice(sound) for _ in range(rng.randrange(1, 4)))
    insult = lambda: "zorlik" + rng.choice(sound) + rng.choice(["", "s"])

    def text(toxic):
        words = [word() for _ in range(rng.randrange(60, 120))]
        for at in rng.sample(range(len(words)), 4):
            if toxic:
                words[at] = insult()
        if not toxic and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "zorlik"
        if not toxic and rng.random() < 0.05:
            words[rng.randrange(len(words))] = insult()
        return ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), int(toxic)

    model = toxicity.train([text(i % 5 == 0) for i in range(600)])
    held = [text(i % 5 == 0) for i in range(200)]
    got = [p >= toxicity.THRESHOLD for p in toxicity.probabilities(model, [t for t, _ in held])]
    assert sum(g and y for g, (_, y) in zip(got, held, strict=True)) >= 38 and sum(g and not y for g, (_, y) in zip(got, held, strict=True)) <= 2
    # One insult alone is seen, but as often in clean texts as in toxic ones it doesn't make a text toxic; the stem is not seen.
    margin = dict(zip(["zorlik", "zorlikten", "zorlikpos"], model.margins(["zorlik", "zorlikten", "zorlikpos"]), strict=True))
    assert margin["zorlik"] < 0 < min(margin["zorlikten"], margin["zorlikpos"])


def test_all_languages_of_the_larger_table():
    """Held-out recall above 0.85 and precision above 0.95 in each language; insults high, bare stems low."""
    sf = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas().set_index("doc_id")
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().dropna(subset=["toxic"])
    rows = [(i, docs.text[i] or "", docs.lang[i], int(y)) for i, y in zip(labels.doc_id, labels.toxic, strict=True) if i in docs.index]
    held = lambda i: zlib.crc32(str(int(i)).encode()) % 3 == 1
    model = toxicity.train([(t, y) for i, t, _, y in rows if not held(i)])
    out = [r for r in rows if held(r[0])]
    marked = np.array(toxicity.probabilities(model, [t for _, t, _, _ in out])) >= toxicity.THRESHOLD
    for lang in ("de", "en", "es", "fr"):
        y = np.array([k for *_, k in out], bool)
        here = np.array([tongue == lang for _, _, tongue, _ in out])
        hits = (marked & y & here).sum()
        assert hits > 0.85 * (y & here).sum() and hits > 0.95 * (marked & here).sum(), lang
    assert min(toxicity.probabilities(model, ["idiot", "scum", "you idiot"])) > 0.9
    assert max(toxicity.probabilities(model, ["achlich", "réeux", "boco", ""])) < 0.5


def test_against_the_plain_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = model if len(model.keys) else toxicity.train([(t, y) for _, t, y in corpus(300)])
    for r in toxicity.score(docs, model).collect():
        assert r["toxicity"]["score"] == pytest.approx(plain_score(model, r["text"] or ""), abs=1e-5)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in labels and r["held_out"]]
    found = sum(a and b for a, b in known)
    # With 33 toxic texts to learn from, 14 of 18 held-out ones are found, as by the version before; none is false.
    assert found >= 0.75 * sum(a for a, _ in known) > 0 and found >= 0.99 * sum(b for _, b in known)


def test_sample_gives_back_its_sentences():
    texts = ["One two. Two three!\nfour", "", "  . ", "i d i o t s, 白痴白 x", "one"]
    sample = toxicity.Sample(texts)
    assert [sample.sentences(i) for i in range(len(texts))] == [toxicity.sentences(t) for t in texts]
    assert [sample.named(sample.bag(i)) for i in range(len(texts))] == [toxicity.tokens(t) for t in texts]


def test_contexts_are_counted_whole_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["ab", "bc", "cd", "de", "ef"], k=50)) for _ in range(40)] + [""]
    sample = toxicity.Sample(texts)
    some = np.array([0, 3, 4, 11, 40, 39])
    padded = [["", *texts[i].split(), ""] for i in some]
    of = Counter(b for _, b, _ in {x for t in padded for x in zip(t, t[1:], t[2:], strict=False)})
    for at_once in (10, 250_000):
        monkeypatch.setattr(toxicity, "CONTEXTS_AT_ONCE", at_once)
        assert dict(zip(sample.words, sample.contexts(some).tolist(), strict=True)) == of


def test_training_holds_few_bytes_a_word():
    """The driver's memory: a million words of texts, then the subsequences of 20,000 words."""
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    rows = [(" ".join(rng.choices(pool, k=2000) + ["moronface"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(500)]
    tracemalloc.start()
    try:
        model = toxicity.train(rows, rounds=2, folds=2)
        training = tracemalloc.get_traced_memory()[1]
        words = sorted({"moron" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)})
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        model.margins(words)
        scoring = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(model.keys) and training < 48e6 and scoring < 48e6, (training, scoring)
