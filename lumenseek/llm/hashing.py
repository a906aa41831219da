"""Words, and hashes of runs of bytes or words, for many documents at once in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. These are ASCII, so bytes and code points agree.
Run hashes are polynomials modulo 2**64 over prefix sums: any window costs two look-ups and a multiplication.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Two odd multipliers; with both, a window has 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed whole by another function.
LONG_WORD = 4096
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 and so on; the longest table made so far is kept."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on for size[0] places, then from start[1], and so on."""
    upto = np.cumsum(size)
    place = np.arange(upto[-1] if len(upto) else 0, dtype=np.int64)
    place += np.repeat(start - upto + size, size)
    return place


class Runs:
    """Prefix sums of values, to hash any run of them."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, length: int) -> np.ndarray:
        """Of every run of this length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


class Words:
    """The words of documents whose bytes lie one after another in data; bounds has len(documents) + 1 offsets."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            edge[0], edge[-1] = word[0], word[-1]
            edge[1:-1] = word[1:] != word[:-1]
            # a document's end also ends its last word
            inner = bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            both = np.unique(inner[word[inner] & word[inner - 1]])
        else:
            both = np.empty(0, np.int64)
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]), kind="stable")
        self.data, self.bounds = data, bounds
        self.start, self.end = at[0::2], at[1::2]
        #: index of the first word of each document, and of the end of the last
        self.first = np.searchsorted(self.start, bounds, "left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.count)

    def hashes(self, data: np.ndarray | None = None, seed: int = BASES[1]) -> np.ndarray:
        """Of each word, from its bytes in data (by default those the words were found in), eight at a time."""
        data = self.data if data is None else data
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * np.uint64(BASES[0]) + np.uint64(seed))
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eights = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))
        at, todo = self.start, None
        for done in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
            if done:
                todo = np.flatnonzero(size > done) if todo is None else todo[size[todo] > done]
                part = eights[at[todo] + done] & _LOW[np.minimum(size[todo] - done, 8)]
                out[todo] = mix(out[todo] + part)
            else:
                out = mix(out + (eights[at] & _LOW[np.minimum(size, 8)]))
        for k in np.flatnonzero(size > LONG_WORD):
            rest = data[self.start[k] : self.end[k]].tobytes()
            out[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(rest, digest_size=8).digest(), "little"))
        return out

    def __len__(self) -> int:
        return len(self.start)
