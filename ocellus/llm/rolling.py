"""Rolling hashes of byte ranges and word n-grams in numpy, over many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte, and an odd base; arithmetic is modulo 2**64.
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BASE = int(_RNG.integers(1, 2**63)) * 2 + 1
#: Bytes that arrays of eight bytes for each are made of at a time.
BLOCK = 1 << 20
INVERSE = pow(BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
TAIL = np.zeros(256, bool)  # bytes that go on a code point
TAIL[0x80:0xC0] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prefix:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, n: int) -> np.ndarray:
        """Of all ranges of length n."""
        if n >= len(self.sum):
            return np.zeros(0, np.uint64)
        return mix((self.sum[n:] - self.sum[:-n]) * self.down[: len(self.sum) - n])


class Words:
    """The words of many texts: maximal runs of bytes that aren't blank."""

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANKS):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        word = ~blank[self.buf]
        if len(self.offsets) > 1:
            word[self.offsets[1:] - 1] = False
        edge = np.diff(np.r_[False, word].view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: words before each text's first, and the text of each word
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _blocks(self):
        """Words of about BLOCK bytes at a time: their range, their bytes, and where these begin. Arrays by byte are never longer."""
        a = 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + BLOCK, side="right")))
            yield a, b, self.buf[self.starts[a] : self.ends[b - 1]], self.starts[a]
            a = b

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        out = np.zeros(len(self.starts), np.int64)
        for a, b, part, at in self._blocks():
            points = np.r_[0, np.cumsum(~TAIL[part])]
            out[a:b] = points[self.ends[a:b] - at] - points[self.starts[a:b] - at]
        return out

    def hashes(self) -> np.ndarray:
        """The same for equal words, wherever they stand."""
        out = np.zeros(len(self.starts), np.uint64)
        for a, b, part, at in self._blocks():
            out[a:b] = Prefix(BYTE[part])(self.starts[a:b] - at, self.ends[a:b] - at)
        return out

    def count(self, which: np.ndarray) -> np.ndarray:
        """Bytes of each text that ``which``, by byte value, is true of."""
        return np.diff(np.searchsorted(np.flatnonzero(which[self.buf]), self.offsets))

    def totals(self, per_word: np.ndarray) -> np.ndarray:
        """Sums by text."""
        sums = np.r_[0, np.cumsum(per_word)]
        return sums[self.first[1:]] - sums[self.first[:-1]]


def repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = np.zeros(len(keys), bool)
    if len(twice):
        low = np.uint64((1 << 20) - 1)
        seen = np.zeros(1 << 20, bool)
        seen[(twice & low).astype(np.int64)] = True
        some = np.flatnonzero(seen[(keys & low).astype(np.int64)])
        at = np.minimum(np.searchsorted(twice, keys[some]), len(twice) - 1)
        out[some[twice[at] == keys[some]]] = True
    return out
