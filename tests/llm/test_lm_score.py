"""Context-tree weighting and the unigram base against plain recursions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tensorloom.llm import lm_score, queries


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


class Plain:
    """The same model as nested dictionaries, with probabilities by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            s = self.stream(t)
            for k in range(depth, len(s)):
                for i in range(8):
                    node, bit = (1 << i) | (s[k] >> (8 - i)), (s[k] >> (7 - i)) & 1
                    for d in range(depth + 1):
                        self.n.setdefault((s[k - d : k], node), [0, 0])[bit] += 1
        self.kids = {}
        for c, node in self.n:
            if c:
                self.kids.setdefault((c[1:], node), []).append((c, node))
        self.memo = {}

    def stream(self, t):
        return b"\n" * self.depth + b" ".join(lower(t).encode().split()) + b"\n"

    def pw(self, key):
        if key not in self.memo:
            own = kt(*self.n[key])
            if len(key[0]) == self.depth:
                self.memo[key] = own, 1.0
            else:
                split = sum(self.pw(k)[0] for k in self.kids[key])
                top = max(own, split)
                w = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(split - top))
                self.memo[key] = w, 0.5 * math.exp(own - w)
        return self.memo[key]

    def one(self, ctx, node):
        p, left = 0.0, 1.0
        if (b"", node) not in self.n:
            return 0.5
        for d in range(self.depth + 1):
            key = (ctx[self.depth - d :], node)
            n0, n1 = self.n[key]
            own, stop = (n1 + 0.5) / (n0 + n1 + 1), self.pw(key)[1]
            if d == self.depth or (ctx[self.depth - d - 1 :], node) not in self.n:
                return p + left * own
            p, left = p + left * stop * own, left * (1 - stop)

    def score(self, t):
        s, total = self.stream(t), 0.0
        for k in range(self.depth, len(s)):
            for i in range(8):
                p = self.one(s[k - self.depth : k], (1 << i) | (s[k] >> (8 - i)))
                total += math.log10(p if (s[k] >> (7 - i)) & 1 else 1 - p)
        return total


@pytest.mark.parametrize(("depth", "shard_rows", "head"), [(2, 10**6, 5), (3, 300, 10**5), (5, 10**6, 0)])
def test_against_recursion(spark, depth, shard_rows, head):
    texts = ["the cat sat on the mat", "The CAT ran on the hat", None, "", "äöü the cat", "the the the", " a\tb\n", "cat " * 300, "the cat sat on the mat"]
    rows = list(enumerate(texts)) + [(None, "lost cat")]
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    plain = Plain(train, depth)
    words = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"])
    total, distinct = sum(words.values()), len(words)
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, shard_rows=shard_rows, head_words=head).collect()
    assert len(got) == len(rows)
    texts_of = dict(rows)
    for r in got:
        t = texts_of[r["id"]]
        w = [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(words[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[x] + 1) / (total + distinct + 1)) for x in w))
        assert r["score"] == pytest.approx(plain.score(t), rel=1e-5)


def test_empty_table_and_held_out(spark, sf_dir):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = queries.op7_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0 for r in rows)


def test_rare_side_of_a_frequent_node(spark):
    # "a" follows "a" in 1e8 places and nothing else does: "`" differs from it in the last bit only.
    g = (97 << 8) | 97
    rows = lm_score.trees(spark.createDataFrame([(g, 10**8)], "g long, n long"), 1).orderBy("d", "ctx", "node").toArrow()
    keys = lm_score.Coder.key(*(rows[c].to_numpy().astype(np.int64) for c in ("d", "ctx", "node")))
    order = np.argsort(keys)
    coder = lm_score.Coder(keys[order], rows.column(3).to_numpy()[order].astype(np.float32), 1)
    seen, other = coder.fresh(np.array([g, g - 1]))
    assert other == pytest.approx(math.log10(0.5 / (10**8 + 1)), rel=1e-6) and seen == pytest.approx(8 * math.log10(1 - 0.5 / (10**8 + 1)), rel=1e-4)
