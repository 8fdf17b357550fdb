"""Vectorised words and hashes over many texts at once."""

from __future__ import annotations

import numpy as np

#: Multiplier of the polynomial hash; odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
#: Of a second, independent hash, for where 64 bits are too few.
_OTHER = 0xD1342543DE82EF95
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for every byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OTHER_CODES = mix(BYTE_CODES + np.uint64(0x2545F4914F6CDD1D))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base % 2**64, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


class Prefixes:
    """Polynomial hashes of any stretch of a byte array, from prefix sums; *other* for a second, independent one."""

    def __init__(self, data: np.ndarray, other: bool = False):
        codes, base = (_OTHER_CODES, _OTHER) if other else (BYTE_CODES, _BASE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * _power(base, len(data)), out=self.sums[1:])
        self.back = _power(pow(base, -1, 2**64), len(data) + 1)

    def of(self, start, stop) -> np.ndarray:
        """Hashes of data[start:stop]; equal bytes give equal hashes wherever they stand."""
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def joined_bytes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each followed by a line feed; end of each text, without it)."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    data = b"\n".join([*encoded, b""])
    ends = np.cumsum([len(e) + 1 for e in encoded], dtype=np.int64) - 1 if encoded else np.zeros(0, np.int64)
    return np.frombuffer(data.translate(_LOWER) if lower else data, np.uint8), ends


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text): A-Z lower-cased, words are runs without ASCII white space."""
    data, ends = joined_bytes(texts, lower=True)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = _BLANK[data]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stop = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))
    count = np.diff(np.searchsorted(start, ends), prepend=0)
    return Prefixes(data).of(start, stop), count


def shingles(words: np.ndarray, count: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words, of the whole sequence; none without words."""
    if len(words) >= width:
        rows = words[:len(words) - width + 1] * np.uint64(3)
        for k in range(1, width):
            rows = mix(rows + words[k:len(words) - width + 1 + k])
    out, begin = [], 0
    for n in count.tolist():
        if n >= width:
            own = np.unique(rows[begin:begin + n - width + 1])
        elif n:
            own = np.array([n], np.uint64)
            for w in words[begin:begin + n]:
                own = mix(own * np.uint64(5) + w)
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        begin += n
    return out
