"""64-bit hashes of words and word sequences, computed for many texts at once in numpy.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. A word's
hash is a polynomial over its bytes (each replaced by a random 64-bit value) modulo
2**64, taken from prefix sums; results don't depend on process, position or chunk.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers, a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        grow = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _powers = grow(_BASE), grow(_BASE_INVERSE)
    return _powers


def _words_of_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a block of lower-cased bytes."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the hashes of text k are ``hashes[offsets[k]:offsets[k + 1]]``."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = b"\n".join(raw)
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    whole = np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        stop = at + _BLOCK
        while stop < len(data):  # blocks end at white space
            gaps = np.flatnonzero(_SPACE[whole[stop : stop + _BLOCK]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += _BLOCK
        s, h = _words_of_block(whole[at : min(stop, len(data))])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    return np.searchsorted(np.concatenate(starts), begins), np.concatenate(hashes)


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of each sequence whose k-th members stand in ``parts[k]``."""
    h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        h = mix(h * _BASE + p)
    return h


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): sorted distinct shingles of ``size`` words; a shorter text's words as one."""
    offsets, words = word_hashes(texts)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(words) - size + 1
    if n > 0:
        # of a sum of products, one mix: cheaper than sequence_hash() over every position
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h += words[k : k + n] * np.uint64(pow(int(_BASE), k + 1, 1 << 64))
        whole = owner[:n] == owner[size - 1 : size - 1 + n]
        doc, h = owner[:n][whole], mix(h[whole])
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        one = [sequence_hash([words[offsets[i] + k : offsets[i] + k + 1] for k in range(counts[i])])[0] for i in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(one, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[fresh], h[fresh]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), h
