"""Window hashes of token sequences, whole-array at a time, and the content-defined anchors among them."""

from __future__ import annotations

from array import array
from hashlib import blake2b

import numpy as np

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Odd multipliers of the window hashes.
BASE, BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Word types that a task remembers, and the most bytes of such a word.
REMEMBERED, LONG = 200_000, 64

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    word = np.empty(len(data) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_BLANK[data]
    turn = np.diff(word)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


class WordHashes(dict):
    """Two independent 64-bit hashes of words, halves of one cryptographic digest; remembers up to REMEMBERED word types."""

    def __init__(self):
        super().__init__()
        self.first, self.second = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        at = len(self.first)
        digest = blake2b(word, digest_size=16).digest()
        self.first.append(int.from_bytes(digest[:8], "little"))
        self.second.append(int.from_bytes(digest[8:], "little"))
        if len(word) <= LONG:
            self[word] = at
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First and second hash of each word."""
        if len(self.first) > REMEMBERED:
            self.clear()
            self.first, self.second = array("Q"), array("Q")
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.first, dtype=U64)[ids], np.frombuffer(self.second, dtype=U64)[ids]


def _join(x: np.ndarray, y: np.ndarray, base: int) -> np.ndarray:
    """Hash of pairs; every bit of both ends up in the high and low half."""
    z = x * U64(base)
    z += y
    z ^= z >> U64(32)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(29)
    return z


def grams(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every k consecutive values, by doubling; empty if there are fewer. The steps in between are not linear, so
    patterns of values can't cancel out as in a polynomial."""
    if len(h) < k:
        return np.empty(0, dtype=U64)
    out, size, part, m = None, 0, h, 1
    while True:
        if k & m:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - size)
                out = _join(out[:n], part[size : size + n], base)
            size += m
        if size == k:
            return out[: len(h) - k + 1]
        part = _join(part[:-m], part[m:], base)
        m *= 2


def _slide(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over every w consecutive values."""
    m = 1
    n = len(x) - w + 1
    while 2 * m <= w:
        x = pick(x[:-m], x[m:])
        m *= 2
    return x[:n] if m == w else pick(x[:n], x[w - m : w - m + n])


class Anchors:
    """The k-grams that are smallest in some window of the sequence.

    A window spans `window` tokens, hence window - k + 1 grams. Which of its grams are smallest depends on its content
    alone, so two equal windows hold an equal anchor at the same place: whoever shares no anchor shares no window."""

    def __init__(self, tokens: np.ndarray, window: int, k: int):
        self.window, self.k, self.n = window, k, len(tokens)
        w = window - k + 1
        if len(tokens) < window:
            self.grams = self.least = np.empty(0, dtype=U64)
            self.at = np.empty(0, dtype=np.int64)
            return
        self.grams = mix(grams(tokens, k, BASE_A)) | U64(1)
        self.least = _slide(self.grams, w, np.minimum)
        padded = np.concatenate([np.zeros(w - 1, dtype=U64), self.least, np.zeros(w - 1, dtype=U64)])
        self.at = np.flatnonzero(_slide(padded, w, np.maximum) == self.grams)

    def windows_of(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of the windows of which a chosen anchor (place) is a smallest gram."""
        only = np.full(len(self.grams), _MASK, dtype=U64)
        only[chosen] = self.grams[chosen]
        return np.flatnonzero(_slide(only, self.window - self.k + 1, np.minimum) == self.least)


#: Windows of a sequence that are looked at together.
PIECE = 1 << 20


def _pieces(n: int, window: int):
    """(first window, end of its tokens) of stretches that together start every window of n tokens."""
    for a in range(0, max(n - window + 1, 0), PIECE):
        yield a, min(a + PIECE + window - 1, n)


def anchor_places(tokens: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors of a sequence of any length, and their gram hashes."""
    at, grams_ = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=U64)]
    for a, b in _pieces(len(tokens), window):
        x = Anchors(tokens[a:b], window, k)
        new = x.at + a > (at[-1][-1] if len(at[-1]) else -1)  # an anchor of the overlap counts once
        at.append(x.at[new] + a)
        grams_.append(x.grams[x.at[new]])
    return np.concatenate(at), np.concatenate(grams_)


def anchored_windows(tokens: np.ndarray, window: int, k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows with a chosen anchor, place and hash of the first such anchor in each); chosen sorted."""
    out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=U64))]
    for a, b in _pieces(len(tokens), window):
        own = chosen[(chosen >= a) & (chosen <= b - k)] - a
        if not len(own):
            continue
        x = Anchors(tokens[a:b], window, k)
        at = x.windows_of(own)
        i = np.searchsorted(own, at)
        while (miss := x.grams[own[i]] != x.least[at]).any():
            i = i + miss
        out.append((at + a, own[i] + a, x.grams[own[i]]))
    return tuple(np.concatenate(c) for c in zip(*out))


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n tokens lie in a run [start, start + length)."""
    turn = np.zeros(n + 1, dtype=np.int64)
    np.add.at(turn, starts, 1)
    np.add.at(turn, np.minimum(starts + lengths, n), -1)
    return np.cumsum(turn[:-1]) > 0


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers -> firsts and sizes of their runs of neighbours."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = np.r_[0, cut]
    return starts[first], np.diff(np.r_[first, len(starts)])
