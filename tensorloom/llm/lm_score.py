"""Language-model scores: context-tree weighting over binary-decomposed bytes, and an add-one unigram base.

A text is the bytes of its words, A-Z lower-cased, one blank between words and one end mark. Each byte is eight binary
decisions; each decision has a tree of contexts, the DEPTH bytes before. Counts of (context, byte) come from all
training texts. Every node of a tree has a Krichevsky-Trofimov estimate, and bottom-up weights mix the estimates of
all depths: P_w = 1/2 P_kt + 1/2 product of the children's P_w. The posterior weights give the probability of a
further bit; where the deeper context was never seen, the deepest one that was stands in for it. Trees, weights and
probabilities are tables that Spark aggregates level by level. Scoring broadcasts the tables in shards of at most
SHARD_ROWS rows or so, each over the positions whose context falls into it; a text's score is the sum over shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, table
from .sentencepiece_codec import _pieces

DEPTH = 5
#: Rows of a shard of the model that is broadcast (12 bytes each), and its words that are counted in a task's own table.
SHARD_ROWS, HEAD_WORDS = 8_000_000, 200_000
#: Distinct words, and byte sequences, that a counting task holds before it emits them.
FLUSH, FLUSH_SEQUENCES = 300_000, 700_000
#: Positions that a counting task holds before it sorts them.
HELD_POSITIONS = 2_000_000
#: Characters of text that are turned into numbers at once, unless one text is longer.
PIECE_CHARS = 500_000
END = b"\n"
#: Logarithms of rare words are summed as whole numbers of this part, hence the same in any order.
SCALE = float(1 << 32)
_SHARD_BYTES = 3


def _streams(texts: list[str | None], depth: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words, and over all texts: (context, byte) as one number for each position, its text, and text ends."""
    bags = [(t or "").encode().lower().split() for t in texts]
    parts = [END * depth + b" ".join(w) + END for w in bags]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    g = raw.copy()
    for d in range(1, depth + 1):
        g[d:] |= raw[:-d] << (8 * d)
    starts = np.cumsum(size) - size
    real = np.ones(len(raw), bool)
    for d in range(depth):
        real[starts + d] = False
    lengths = size - depth
    return bags, g[real], lengths, np.cumsum(lengths) - lengths


def counts(train: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """(g, w, n): how often each (context, byte) number g and each word w (the end mark for ends) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, n
            new, many = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            held.clear()
            if len(keys):
                both = np.concatenate([keys, new])
                keys, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([n, many]), len(keys)).astype(np.int64)
            else:
                keys, n = new, many

        def out_words() -> pa.RecordBatch:
            k, v = list(words), list(words.values())
            words.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.array(k, pa.binary()), pa.array(v, pa.int64())], names=["g", "w", "n"])

        def out_grams() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.binary()), pa.array(n)], names=["g", "w", "n"])

        for whole in batches:
            for b in _pieces(whole, 0, PIECE_CHARS):
                bags, g, _, _ = _streams(b.column(0).to_pylist(), depth)
                for w in bags:
                    words.update(w)
                words[END] += len(bags)
                held.append(g)
                if len(words) > FLUSH:
                    yield out_words()
                if sum(map(len, held)) > HELD_POSITIONS:
                    merge()
                    if len(keys) > FLUSH_SEQUENCES:
                        yield out_grams()
                        keys, n = keys[:0], n[:0]
        merge()
        yield out_words()
        yield out_grams()

    return train.select(text).mapInArrow(run, "g long, w binary, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))


def _lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2: Stirling's series seven steps further on."""
    x = x.cast("double")
    y = x + 7
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(product)


def _kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - float(np.log(np.pi))


def trees(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(d, ctx, node, odds): ln of the odds of a one at each seen node (1 to 255) of each seen context of d bytes, unless the context of d - 1 bytes gives the same."""
    bits = [F.struct(F.lit(1 << i).bitwiseOR(F.shiftright("b", 8 - i)).cast("int").alias("node"), F.shiftright("b", 7 - i).bitwiseAND(F.lit(1)).alias("bit")) for i in range(8)]
    leaf = grams.select(F.shiftright("g", 8).alias("ctx"), F.col("g").bitwiseAND(F.lit(255)).cast("int").alias("b"), "n").select("ctx", "n", F.explode(F.array(*bits)).alias("x"))
    leaf = leaf.groupBy("ctx", F.col("x.node").alias("node")).agg(F.sum(F.when(F.col("x.bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("x.bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = {depth: table(leaf.select("*", _kt(F.col("n0"), F.col("n1")).alias("pw"), F.lit(1.0).alias("stop")))}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("split"))
        up = up.withColumn("kt", _kt(F.col("n0"), F.col("n1"))).withColumn("top", F.greatest("kt", "split"))
        mix = F.col("top") + F.log(0.5 * F.exp(F.col("kt") - F.col("top")) + 0.5 * F.exp(F.col("split") - F.col("top")))
        levels[d] = table(up.withColumn("pw", mix).select("ctx", "node", "n0", "n1", "pw", (0.5 * F.exp(F.col("kt") - F.col("pw"))).alias("stop")))
    own = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    # What is left for deeper nodes, and the probability gathered above; a node's own p is as if it were the deepest.
    # A node with all the counts of the one above it has the same p and is left out.
    seen = (F.col("n0") + F.col("n1")).alias("seen")
    now = levels[0].select("ctx", "node", "stop", own.alias("kt"), F.lit(1.0).alias("left"), F.lit(0.0).alias("sum"), seen, F.lit(True).alias("new"))
    found, p = None, F.col("sum") + F.col("left") * F.col("kt")
    for d in range(depth + 1):
        now = table(now)
        here = now.where("new").select(F.lit(d).alias("d"), "ctx", "node", p.alias("p")).select("d", "ctx", "node", (F.log("p") - F.log(1 - F.col("p"))).alias("odds"))
        found = here if found is None else found.union(here)
        if d < depth:
            above = now.select(F.col("ctx").alias("_c"), F.col("node").alias("_n"), F.col("seen").alias("_seen"), (F.col("left") * (1 - F.col("stop"))).alias("left"), (F.col("sum") + F.col("left") * F.col("stop") * F.col("kt")).alias("sum"))
            below = levels[d + 1].select("ctx", "node", "stop", own.alias("kt"), seen, F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("_c"), F.col("node").alias("_n"))
            now = below.join(above, ["_c", "_n"]).select("ctx", "node", "stop", "kt", "left", "sum", "seen", (F.col("seen") != F.col("_seen")).alias("new"))
    return found


class Coder:
    """log10 probabilities of (context, byte) numbers, from the sorted rows of one shard of the model."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray, depth: int):
        # ln of the odds: float32 keeps both sides' relative precision, where p itself would round to 1.
        self.keys, self.odds, self.depth = keys, odds, depth
        self.bits = 18
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)

    @staticmethod
    def key(d: int, ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (ctx << 11) | (d << 8) | node

    def fresh(self, g: np.ndarray) -> np.ndarray:
        """log10 probabilities of distinct numbers, bit by bit from the deepest context that has the node."""
        out = np.zeros(len(g))
        ctx, byte = g >> 8, g & 255
        for i in range(8):
            node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
            odds, open_ = np.zeros(len(g)), np.arange(len(g))
            for d in range(self.depth, -1, -1):
                k = self.key(d, ctx[open_] & ((1 << 8 * d) - 1), node[open_])
                at = np.minimum(np.searchsorted(self.keys, k), max(len(self.keys) - 1, 0))
                hit = self.keys[at] == k if len(self.keys) else np.zeros(len(k), bool)
                odds[open_[hit]] = self.odds[at[hit]]
                open_ = open_[~hit]
            out -= np.logaddexp(0, np.where(bit == 1, -odds, odds)) / np.log(10)
        return out

    def score(self, g: np.ndarray) -> np.ndarray:
        """log10 probabilities of numbers; a direct-mapped table keeps what was computed last for each slot."""
        slot = ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        miss = np.nonzero(self.slots[slot] != g)[0]
        if len(miss):
            new, at = np.unique(g[miss], return_inverse=True)
            value = self.fresh(new)
            out[miss] = value[at]
            if self.bits < 21 and len(new) > 1 << (self.bits - 2):
                self.bits = 21
                self.slots, self.values = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21)
            where = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
            self.slots[where], self.values[where] = new, value
        return out


def _head_count(vocabulary: DataFrame, words: int) -> int:
    """A count that at most so many words reach, from a histogram of counts in at most 64 * 32 bins."""
    shift = F.greatest(F.length(F.bin("c")) - 6, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("c"), shift), shift)
    least, total = 1 << 62, 0
    for r in sorted(vocabulary.groupBy(low.alias("low")).count().collect(), reverse=True):
        total += r["count"]
        if total > words:
            break
        least = r["low"]
    return least


def score(docs: DataFrame, text: str = "text", ident: str = "doc_id", modulus: int = 7, held: int = 2, depth: int = DEPTH, shard_rows: int = SHARD_ROWS, head_words: int = HEAD_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs.

    score is the log10 probability of the text's bytes, bits_per_byte its code length over their number, the end
    included. Texts whose crc32(id as text) mod modulus is `held` are held out of all counts. Null and empty texts are
    one end mark; texts of any length are scored whole. Repeated rows count and score each time, and equal texts score
    alike; a null id counts as empty text for the split; without training texts each bit has probability 1/2 and the
    base score is 0; an empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"), (bucket(F.col(ident), modulus) == held).alias("held_out"))
    found = table(counts(docs.where(~F.col("held_out")), "text", depth))
    vocabulary = found.where(F.col("w").isNotNull()).select("w", F.col("n").alias("c"))
    total = vocabulary.agg(F.sum("c"), F.count("c"), F.max(F.when(F.col("w") == F.lit(END), F.col("c")))).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    ends = {END: float(np.log10(total[2] + 1.0))} if total[2] else {}
    head = vocabulary.where(F.col("c") >= _head_count(vocabulary, head_words)).toArrow()
    model = table(trees(found.where(F.col("g").isNotNull()).select("g", "n"), depth))
    shards = max(1, -(-model.count() // shard_rows))
    spark = docs.sparkSession
    # Rows get their numbers once: where several shards read the texts, from a written table.
    rows_ = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text", "held_out")
    rows_ = table(rows_) if shards > 1 else rows_
    logs = spark.sparkContext.broadcast(dict(zip(head["w"].to_pylist(), np.log10(head["c"].to_numpy() + 1.0).tolist(), strict=True)) | ends)

    def one(k: int) -> DataFrame:
        rows = model.where((F.col("d") < _SHARD_BYTES) | (F.pmod(F.col("ctx").bitwiseAND(F.lit((1 << 8 * _SHARD_BYTES) - 1)), F.lit(shards)) == k)) if shards > 1 else model
        a = rows.select(F.shiftleft("ctx", 11).bitwiseOR(F.shiftleft("d", 8).cast("long")).bitwiseOR(F.col("node").cast("long")).alias("k"), F.col("odds").cast("float").alias("odds")).toArrow()
        # Each copy goes before the next one is made: a shard is about 100 MB.
        keys, odds = a["k"].to_numpy(), a["odds"].to_numpy()
        del a
        order = np.argsort(keys)
        keys = keys[order]
        odds = odds[order]
        del order
        shipped = spark.sparkContext.broadcast((keys, odds))
        del keys, odds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = Coder(*shipped.value, depth)
            known = logs.value
            for whole in batches:
                for b in _pieces(whole, 2, PIECE_CHARS):
                    bags, g, lengths, starts = _streams(b.column(2).to_pylist(), depth)
                    if shards > 1:
                        mine = ((g >> 8) & ((1 << 8 * _SHARD_BYTES) - 1)) % shards == k
                        each = np.zeros(len(g))
                        each[mine] = coder.score(g[mine])
                    else:
                        each = coder.score(g)
                    sums = np.add.reduceat(each, starts)
                    if k:
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.float64())], names=["row", "score"])
                        continue
                    end = known.get(END)
                    logs_ = [list(map(known.get, bag)) for bag in bags]
                    tail = [[w for w, x in zip(bag, at, strict=True) if x is None] if None in at else [] for bag, at in zip(bags, logs_, strict=True)]
                    hits = [[x for x in at if x is not None] if t else at for at, t in zip(logs_, tail, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(x) for x in (0, 1, 3)), pa.array(lengths), pa.array([len(x) + 1 for x in bags], pa.int64()), pa.array([len(x) + (end is not None) for x in hits], pa.int64()), pa.array([sum(x) + (end or 0.0) for x in hits], pa.float64()), pa.array(sums, pa.float64()), pa.array(tail, pa.list_(pa.binary()))],
                        names=["row", "id", "held_out", "bytes", "n_tokens", "head_known", "head_log", "score", "tail"],
                    )

        return rows_.mapInArrow(run, "row long, score double" if k else "row long, id long, held_out boolean, bytes long, n_tokens long, head_known long, head_log double, score double, tail array<binary>")

    first = table(one(0))
    for k in range(1, shards):
        more = table(one(k).select("row", F.col("score").alias("_more")))
        first = table(first.join(more, "row").withColumn("score", F.col("score") + F.col("_more")).drop("_more"))
    rare = first.select("row", F.explode("tail").alias("w")).join(vocabulary, "w").groupBy("row").agg(F.count(F.lit(1)).alias("tail_known"), (F.sum(F.round(F.log10(F.col("c") + 1) * SCALE).cast("long")) / SCALE).alias("tail_log"))
    out = first.drop("tail").join(rare, "row", "left")
    n = F.col("n_tokens")
    return out.select(
        "id", "held_out", n, (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - n * float(np.log10(tokens + distinct + 1))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
