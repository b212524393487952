"""Words of many texts at once as numpy arrays: places, byte spans and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}

#: ASCII A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters and digits: bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after LOWER.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between white space: bytes of [^\x20\x09-\x0D].
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), _BASE if kind == "base" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of one slice: row, byte span, hash; first[r]:first[r + 1] are those of row r."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def find_words(texts: pa.Array, is_word: np.ndarray, lower: bool = True, strong: bool = False) -> Words:
    """The words of some texts. Their hash is a polynomial of their bytes; texts can be made whose words agree in it without being equal.

    With `strong` each byte and its place in the word have a mixed value of their own, and the hash is their sum: no rule makes words agree.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    if strong:
        begins = np.zeros(len(data), dtype=np.int64)
        begins[start] = 1
        place = np.arange(len(data)) - np.concatenate([start, [0]])[np.cumsum(begins) - 1]
        np.cumsum(mix((place.astype(np.uint64) << np.uint64(8) | data) + np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        return Words(data, row, start, end, mix(sums[end] - sums[start]), first)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", len(data))[: len(data)], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * _power("inverse", len(data) + 1)[start])
    return Words(data, row, start, end, hashed, first)


def grams(hashes: np.ndarray, row: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one row, and the number of the first. Hashes of two seeds are not independent of each other."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(seed * 2 + 1), dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(h[at]), at


def minima(hashes: np.ndarray, row: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w consecutive grams of one row: number of its first gram, and of the smallest (the last of equals).

    A row of fewer than w grams has one window with all of them.
    """
    n = len(hashes)
    last = np.searchsorted(row, row, side="right")  # one past the row's last gram
    starts = np.flatnonzero((np.arange(n) + w <= last) | (np.arange(n) == np.searchsorted(row, row)))
    best, value, stop = starts.copy(), hashes[starts], last[starts] - 1
    for j in range(1, w):
        i = np.minimum(starts + j, stop)
        less = hashes[i] <= value
        best[less], value[less] = i[less], hashes[i[less]]
    return starts, best


def winnow(hashes: np.ndarray, at: np.ndarray, row: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that are the smallest of some window of w, and the number of their first word."""
    if not len(at):
        return hashes, at
    best = np.unique(minima(hashes, row[at], w)[1])
    return hashes[best], at[best]
