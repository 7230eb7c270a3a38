"""Hashed word shingles of whole batches of texts, without a Python step per word."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and the number of words of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[buf]
    starts = np.nonzero(~space & np.r_[True, space[:-1]])[0]
    ends = np.nonzero(~space & np.r_[space[1:], True])[0] + 1
    with np.errstate(over="ignore"):
        # A word's hash is a polynomial in its bytes: a difference of running sums, moved to the same power by the inverse.
        power = np.multiply.accumulate(np.full(len(buf) + 1, _BASE, np.uint64)) if len(buf) else np.ones(1, np.uint64)
        run = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])]
        back = np.multiply.accumulate(np.full(len(buf) + 1, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64))
        words = mix((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(size)])
    return words, np.diff(bounds)


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """The sorted set of hashed shingles of each text; a text of fewer words is one shingle, one without words none."""
    words, count = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += words[k : n - width + 1 + k] * _STEPS[k % len(_STEPS)] if len(rolled) else np.uint64(0)
        rolled = mix(rolled)
    out, at = [], 0
    for c in count.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            with np.errstate(over="ignore"):
                out.append(mix((words[at : at + c] * _STEPS[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
