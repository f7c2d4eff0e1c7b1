"""Word shingle sets and b-bit minhash signatures, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WIDTH = 5
#: Symbols of a signature and their bits.
SYMBOLS, BITS = 64, 16
#: Words that a task remembers.
MEMO = 1 << 17
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_random = np.random.default_rng(20240229)
PLACE = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
XOR = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
MULTIPLY = _random.integers(1, 1 << 62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sorted_distinct(h: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which hashes integers first and is many times slower."""
    h = np.sort(h)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each whole text; a text of fewer words is one shingle, one without words none."""
    get = _hashes.__getitem__
    for text in texts:
        words = text.encode().translate(LOWER).split() if text else []
        n = len(words)
        if not n:
            yield np.empty(0, np.uint64)
            continue
        h = np.fromiter(map(get, words), np.uint64, n)
        if n < WIDTH:
            yield mix(np.array([(h * PLACE[:n]).sum() + np.uint64(n)], np.uint64))
            continue
        s = h[: n - WIDTH + 1] * PLACE[0]
        for k in range(1, WIDTH):
            s += h[k : n - WIDTH + 1 + k] * PLACE[k]
        yield sorted_distinct(mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` symbols of ``BITS`` bits: from the least value of the set under each of as many hash functions."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, ((shingles[None, at : at + 1024] ^ XOR[:, None]) * MULTIPLY[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(64 - BITS)).astype(np.uint16)
