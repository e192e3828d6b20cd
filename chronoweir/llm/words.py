"""Words of many texts at once as numbers."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which words are hashed together; longer ones are hashed one by one.
_TOGETHER = 64
#: By the number of bytes that count, up to 8, of eight bytes read as a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts, text after text: data has their bytes, which start and stop at places; counts has the number of words by text.

    Words are runs of bytes other than white space; with lower, A-Z count as a-z.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join([*texts, b""])
        self.data = np.frombuffer(joined, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        edge = np.empty(len(space), bool)
        if len(space):
            edge[0], edge[1:] = not space[0], space[1:] != space[:-1]
        edges = np.nonzero(edge)[0]
        self.start, self.stop = edges[::2], edges[1::2]  # the last byte is a space
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(self.start, ends, "left"), prepend=0)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self._eights = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def _part(self, which: np.ndarray, at: int) -> np.ndarray:
        """Up to eight bytes from place `at` of some words on, as numbers."""
        start = self.start[which] + at
        value = np.ascontiguousarray(self._eights[start]).view("<u8").ravel()
        return value & _KEEP[np.minimum(self.stop[which] - start, 8)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, by rounds of mixing eight bytes; long words by BLAKE2."""
        size = self.stop - self.start
        value = size.astype(np.uint64) * _ODD
        live, at = np.flatnonzero(size <= _TOGETHER), 0
        while len(live):
            with np.errstate(over="ignore"):
                value[live] = mixed(value[live] * np.uint64(3) + self._part(live, at))
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > _TOGETHER).tolist():
            value[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.stop[i]].tobytes(), digest_size=8).digest(), "little")
        return value

    def numbers(self) -> np.ndarray:
        """A number from 0 on for each word, equal for equal words and only for them: words with one hash are compared by their bytes."""
        value = self.hashes()
        first, number = np.unique(value, return_index=True, return_inverse=True)[1:]
        size, model = self.stop - self.start, first[number]
        if (size == size[model]).all():
            live, at, same = np.arange(len(size)), 0, True
            while same and len(live) and at < _TOGETHER:
                same = bool((self._part(live, at) == self._part(model[live], at)).all())
                at += 8
                live = live[size[live] > at]
            same = same and all(self._bytes(i) == self._bytes(j) for i, j in zip(live.tolist(), model[live].tolist(), strict=True))
            if same:
                return number
        table: dict[bytes, int] = {}
        return np.array([table.setdefault(self._bytes(i), len(table)) for i in range(len(size))], np.int64)

    def _bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()


def word_numbers(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, text after text, and the number of words of each text."""
    words = Words(texts, lower)
    return words.hashes(), words.counts


def exact_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of these texts and only for them, and the number of words of each text."""
    words = Words(texts, lower)
    return words.numbers(), words.counts


def _runs(counts: np.ndarray, k: int):
    """Of the runs of k words of each text: how many, the first word's place, and the number of words (fewer than k in short texts, which have one)."""
    n = np.maximum(counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    return n, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.minimum(counts, k), n)


def shingle_numbers(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each run of k words of a text, and their number by text; a text of 1 to k - 1 words has one, of all its words."""
    n, at, size = _runs(counts, k)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            some = size > j
            value[some] = mixed(value[some] * np.uint64(5) + words[at[some] + j] + np.uint64(j + 1))
    return value, n


def exact_shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for words from exact_words(): a number for each run, equal for equal runs and only for them."""
    n, at, size = _runs(counts, k)
    value = words[at].astype(np.uint64) + np.uint64(1) if len(at) else np.zeros(0, np.uint64)
    for j in range(1, k):  # numbers are below 2**32
        following = np.where(size > j, words[np.minimum(at + j, max(len(words) - 1, 0))] + 1, 0).astype(np.uint64)
        value = np.unique((value << np.uint64(32)) | following, return_inverse=True)[1].astype(np.uint64)
    return value, n
