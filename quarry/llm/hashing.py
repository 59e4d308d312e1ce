"""Vectorised hashing of words and word windows over a whole Arrow slice of texts.

A word's 64-bit hash is a polynomial over its bytes (each byte first replaced by a random 64-bit
number), taken for all words of a slice at once from one running sum; a mixing step follows. A
window's hash combines the hashes of its words with one odd factor for each place.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose running sum is taken at once; bounds the arrays of one step.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(b):
        p = np.full(n, np.uint64(b & (2**64 - 1)), np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)
    return row(BASE), row(BASE_INVERSE)


class Words:
    """How a text is cut into words: ``space`` holds the byte values that separate words. A-Z count
    as a-z."""

    def __init__(self, space: bytes):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.is_word = np.ones(256, bool)
        self.is_word[list(space)] = False
        self.table = bytes(int(lower[b]) if self.is_word[b] else 32 for b in range(256))
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.values = values[lower]

    def split(self, text: bytes) -> list[bytes]:
        return text.translate(self.table).split()

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte, text number) of every word; words end where their text ends."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z, z, z
        w = self.is_word[data]
        first, last = np.empty(n, bool), np.empty(n, bool)
        first[0], first[1:] = True, ~w[:-1]
        last[-1], last[:-1] = True, ~w[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] = True
        last[cuts - 1] = True
        starts = np.flatnonzero(w & first)
        ends = np.flatnonzero(w & last) + 1
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i, n = 0, len(starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            size = 1 << max(19, (hi - lo - 1).bit_length())
            up, down = _powers(size)
            run = np.empty(hi - lo + 1, np.uint64)
            run[0] = 0
            np.cumsum(self.values[data[lo:hi]] * up[:hi - lo], out=run[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


#: ASCII white space separates words (bytes.split without argument does the same).
PLAIN = Words(b" \t\n\x0b\x0c\r")
#: Letters, digits and every non-ASCII byte make words.
ALNUM = Words(bytes(b for b in range(128) if not chr(b).isalnum()))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words (one value for each start)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width * 0x632BE59BD9B4E019 & (2**64 - 1)), np.uint64)
    for k in range(width):
        out += words[k:k + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1)
    return mix(out)


def text_windows(words: np.ndarray, text_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word number, hash) of every window that lies within one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text_of[:n] == text_of[width - 1:])
    return at, windows(words, width)[at]


def counts_by_text(text_of: np.ndarray, n_texts: int) -> np.ndarray:
    return np.bincount(text_of, minlength=n_texts).astype(np.int64)
