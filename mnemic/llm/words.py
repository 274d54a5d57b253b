"""Words of whole batches of texts as flat arrays: the common ground of the operators on word runs.

A word is a maximal run of letters and digits in the lower-cased text. Words are turned into 64-bit codes
(a hash of the word, computed once per distinct word of a batch), runs of words into a mix of their codes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash

WORD = re.compile(r"[^\W_]+")
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M[1]
    h = h ^ (h >> np.uint64(29))
    h = h * _M[2]
    return h ^ (h >> np.uint64(32))


def codes(words: list[str]) -> np.ndarray:
    """A 64-bit code of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    at, distinct = pd.factorize(np.array(words, dtype=object))
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return own[at]


def flatten(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts, and where each text's words start (one more entry than texts)."""
    words: list[str] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words += WORD.findall(text.lower())
        starts[i + 1] = len(words)
    return codes(words), starts


def runs(code: np.ndarray, starts: np.ndarray, k: int, keep: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of k words that lies within one text, and where each text's runs start.

    ``keep`` are the positions within the run that count (all by default).
    """
    keep = tuple(range(k)) if keep is None else keep
    sizes = np.diff(starts)
    n = np.maximum(sizes - k + 1, 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(starts[:-1] - out[:-1], n)
    h = np.full(len(at), np.uint64(k))
    for p in keep:
        h = mix(h * _M[0] + code[at + p])
    return h, out
