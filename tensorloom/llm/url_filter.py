"""URL filters: domain and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, carried, released

#: Labelled URLs that the trees are trained on at most: those whose hash is smallest.
MAX_LABELLED = 20_000
#: Rows are dealt by host into so many parts; a part's suffix odds come from the others while the trees are trained.
FOLDS = 5
ROUNDS, LEVELS, BINS, RATE, RIDGE = 40, 3, 32, 0.2, 1.0
THRESHOLD = 0.5
FEATURES = "length host_length path_length depth labels digit_share host_digit_share entropy host_entropy hyphens parameters query_length dots longest_label suffix_odds".split()


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; "" without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the host up to ?, # or the end; "" without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (host/path..., verdict) that fits, as struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.bincount(np.frombuffer(s.encode("utf-32-le"), np.uint32) % 256)
    p = n[n > 0] / len(s)
    return float(-(p * np.log2(p)).sum())


def _suffix(h: str) -> str:
    return h.rpartition(".")[2]


def features(urls: Sequence[str | None], odds: dict[str, float]) -> np.ndarray:
    """One row of FEATURES for each URL; null counts as empty."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, u in enumerate(urls):
        u = u or ""
        rest = u.partition("://")[2]
        cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
        h, tail = rest[:cut].lower(), rest[cut:]
        p, _, q = tail.partition("#")[0].partition("?")
        labels = h.split(".")
        digits = sum(map(str.isdigit, u))
        out[i] = (
            len(u), len(h), len(p), sum(bool(x) for x in p.split("/")), len(labels), digits / max(1, len(u)), sum(map(str.isdigit, h)) / max(1, len(h)), _entropy(u), _entropy(h),
            h.count("-"), sum(bool(x) for x in q.split("&")), len(q), u.count("."), max(map(len, labels)), odds.get(_suffix(h), 0.0),
        )
    return out


@dataclass
class Trees:
    """Boosted trees of LEVELS levels: each node a (feature, cut), each leaf an addition to the log odds."""

    odds: dict[str, float]
    start: float
    nodes: list[list[tuple[int, float]]]
    leaves: list[np.ndarray]

    def probability(self, urls: Sequence[str | None]) -> np.ndarray:
        """Of block."""
        x = features(urls, self.odds)
        total = np.full(len(x), self.start)
        for nodes, leaves in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(LEVELS):
                f, cut = (np.array([nodes[2**level - 1 + k][j] for k in range(2**level)]) for j in (0, 1))
                at = 2 * at + (x[np.arange(len(x)), f.astype(np.int64)[at]] > cut[at])
            total += leaves[at]
        return 1 / (1 + np.exp(-total))


def train(rows: Sequence[tuple[str | None, int]]) -> Trees:
    """Boost on (url, 1 for block); without both labels the probability is the smoothed share of blocks."""
    y = np.array([float(k) for _, k in rows])
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    hosts = [(u or "").partition("://")[2].partition("/")[0].lower() for u, _ in rows]
    part = np.array([zlib.crc32(h.encode(errors="replace")) % FOLDS for h in hosts], np.int64)

    def odds_of(used: np.ndarray) -> dict[str, float]:
        counts: dict[str, list[int]] = {}
        for k in np.nonzero(used)[0]:
            counts.setdefault(_suffix(hosts[k]), [0, 0])[int(rows[k][1])] += 1
        return {x: float(np.log((b + 10 * share) / (a + 10 * (1 - share)))) - start for x, (a, b) in counts.items()}

    odds = odds_of(np.ones(len(rows), bool))
    model = Trees(odds, start, [], [])
    if not 0 < y.sum() < len(y):
        return model
    x = features([u for u, _ in rows], odds)
    for k in range(FOLDS):
        # A row's own label is no part of its suffix's odds.
        here = np.nonzero(part == k)[0]
        x[here] = features([rows[i][0] for i in here], odds_of(part != k))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    total = np.full(len(y), start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at, nodes = np.zeros(len(y), np.int64), []
        for level in range(LEVELS):
            width = 2**level
            best_gain, best = np.zeros(width), [(0, np.inf)] * width
            where: list[tuple[int, int]] = [(0, BINS)] * width
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = at * (BINS + 1) + binned[:, f]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                k = gain.argmax(axis=1)
                for n in range(width):
                    if gain[n, k[n]] > best_gain[n] + 1e-9:
                        best_gain[n], best[n], where[n] = gain[n, k[n]], (f, float(c[k[n]])), (f, int(k[n]))
            nodes += best
            f, k = np.array([w[0] for w in where])[at], np.array([w[1] for w in where])[at]
            at = 2 * at + (binned[np.arange(len(y)), f] > k)
        leaf = RATE * np.bincount(at, g, 2**LEVELS) / (np.bincount(at, h, 2**LEVELS) + RIDGE)
        model.nodes.append(nodes)
        model.leaves.append(leaf)
        total += leaf[at]
    return model


def fit(labelled: DataFrame, url: str = "url", label: str = "block", bound: int = MAX_LABELLED) -> Trees:
    """Train on at most `bound` rows of (url, 0 or 1), those of the smallest hashes; null labels are not used."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("u"), F.col(label).cast("int").alias("k")).distinct()
    # Hashes up to this one hold the smallest `bound` rows and few more, so that sorting for them moves few rows.
    share = min(1.0, 1.2 * bound / max(1, rows.count()))
    near = rows.withColumn("h", F.xxhash64("u")).where(F.col("h") <= min(int(-(2**63) + share * 2**64), 2**63 - 1))
    return train([(r["u"], r["k"]) for r in near.orderBy("h", "u", "k").limit(bound).collect()])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: Trees, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """pages with `link`: struct of host, path, rule (null if none fits), verdict (allow or block) and probability of block.

    A null URL, or one without ://, has an empty host and path and is judged by the trees. URLs of any length are read
    whole; of rules of one length that both fit the one given first holds. Repeated rows are judged alike; a column
    already named link is replaced, any other name passes through; an empty table stays empty.
    """
    schema = T.StructType([carried(pages).schema["row"], T.StructField("url", T.StringType()), T.StructField("p", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(b.column(1).to_pylist()), pa.float64())], names=["row", "url", "p"])

    h, p = host(F.col("url")), path(F.col("url"))
    out = carried(pages, url=F.col(url)).mapInArrow(run, schema).withColumn("rule", rule_for(h, p, rules))
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("p") >= threshold, "block").otherwise("allow"))
    return released(out, link=F.struct(h.alias("host"), p.alias("path"), F.col("rule.rule").alias("rule"), verdict.alias("verdict"), F.col("p").alias("probability")))
