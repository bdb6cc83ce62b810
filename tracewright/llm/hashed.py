"""Hashed text features, and sparse rows of them in numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa

BUCKETS = 1 << 18

_word = re.compile(r"\w+")
_upper, _lower, _digit, _again = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.S)


def _bucket(name: str, seed: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace"), seed) % BUCKETS


class _Cache(dict):
    """Name -> feature; starts anew when it has grown large."""

    MOST = 1 << 16

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, name: str):
        if len(self) >= self.MOST:
            self.clear()
        got = self[name] = self.make(name)
        return got


def _shape(token: str) -> int:
    s = _digit.sub("9", _lower.sub("a", _upper.sub("A", token)))
    return _bucket(_again.sub(r"\1\1", s), 1)


_words, _shapes = _Cache(lambda w: _bucket(w, 0)), _Cache(_shape)


def words_of(text: str | None) -> np.ndarray:
    """Buckets of the different words of the whole text, in lower case."""
    return np.unique(np.fromiter(map(_words.__getitem__, set(_word.findall((text or "").lower()))), dtype=np.int32))


def style_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the whole text's words and of the shapes of what stands between spaces: the root of
    each one's share, words and shapes apart."""
    idx, val = [], []
    tokens = (text or "").split()
    words, shapes = Counter(map(_words.__getitem__, _word.findall((text or "").lower()))), Counter(map(_shapes.__getitem__, tokens))
    for counts in (words, shapes):
        total = sum(counts.values())
        idx += counts.keys()
        val += [(c / total) ** 0.5 for c in counts.values()]
    return np.array(idx, dtype=np.int32), np.array(val, dtype=np.float32)


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column without nulls, as views of one array: as lists of Python's numbers they would take
    ten times that memory."""
    a = column.combine_chunks()
    at, flat = a.offsets.to_pylist(), a.values.to_numpy(zero_copy_only=False)
    return [flat[s:e] for s, e in pairwise(at)]


class Rows:
    """Sparse rows: entry j stands in row ``row[j]`` for feature ``idx[j]`` with value ``val[j]``."""

    def __init__(self, idx: list[np.ndarray], val: list[np.ndarray] | None = None):
        sizes = np.array([len(i) for i in idx], dtype=np.int64)
        self.row = np.repeat(np.arange(len(idx)), sizes)
        self.idx = np.concatenate([*idx, np.zeros(0, np.int32)]).astype(np.int64)
        self.val = np.concatenate([*val, np.zeros(0, np.float32)]).astype(np.float64) if val is not None else np.ones(len(self.idx))
        self.n = len(idx)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.idx], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.idx, weights=self.val * g[self.row], minlength=width)

    def only(self, features: np.ndarray) -> Rows:
        """The rows with these features alone, renumbered from 0."""
        number = np.full(BUCKETS, -1, dtype=np.int64)
        number[features] = np.arange(len(features))
        keep = number[self.idx] >= 0
        out = object.__new__(Rows)
        out.n, out.row, out.idx, out.val = self.n, self.row[keep], number[self.idx[keep]], self.val[keep]
        return out

    def frequent(self, least: int, width: int) -> np.ndarray:
        """Whether a feature occurs in at least so many rows."""
        return np.bincount(self.idx, minlength=width) >= least


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
