"""64-bit hashes of words and of runs of words, for whole Arrow columns at once."""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CHUNKS = 8  # of eight bytes; the bytes of longer words are hashed one word at a time
_PRIME = (1 << 61) - 1
_BASE = 0x11C6E8FEB86659FD
_P, _LOW = np.uint64(_PRIME), np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near-random words from any words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times(factor: np.uint64, n) -> np.ndarray:
    return np.asarray(n).astype(np.uint64) * factor


def _reduce(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^64 modulo 2^61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, from 32-bit halves; 2^61 counts as 1."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    high = (a1 * b1 << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _reduce(high + (low >> np.uint64(61)) + (low & _P))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _product(out, np.array([pow(base, len(out), _PRIME)], np.uint64))])
    return out


class Spans:
    """Hashes of runs of symbols by prefix sums of a polynomial modulo the prime 2^61 - 1. (Modulo 2^64,
    long words in Thue-Morse order would have equal hashes whatever the base.)"""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(Spans._up) < n:
            Spans._up, Spans._down = _powers(_BASE, n), _powers(pow(_BASE, -1, _PRIME), n)
        terms = _product(_reduce(mix(symbols)), Spans._up[: n - 1])
        high, low = np.cumsum(terms >> np.uint64(32)), np.cumsum(terms & _LOW)
        sums = _reduce((high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + low)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), sums])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        run = _product(_reduce(self.prefix[end] + _P - self.prefix[start]), Spans._down[start])
        return mix(run + times(GOLDEN, end - start))


Keys = tuple[int, int]
PLAIN: Keys = (0, 1)


def fresh_keys() -> Keys:
    """Two secret keys for one run. Words of equal hashes can be made for known keys, not for these; and two hashes of a
    word under them are 128 bits that hardly any two words of a corpus share."""
    return secrets.randbits(64), secrets.randbits(64)


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Hashes of raw[start:end] under a key: eight bytes a round, mixed in one after another; words of up to eight bytes
    and equal length have different hashes."""
    size = ends - starts
    out = mix(times(GOLDEN, size) + np.array([key], np.uint64))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place
    live = np.flatnonzero(size > 0)
    for k in range(_CHUNKS):
        left = size[live] - 8 * k
        cut = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        out[live] = mix(out[live] ^ (eight[starts[live] + 8 * k] << cut))
        live = live[left > 8]
        if not len(live):
            return out
    whole = raw.tobytes()
    out[live] = [xxhash.xxh3_64_intdigest(whole[a:b], seed=key) for a, b in zip(starts[live].tolist(), ends[live].tolist(), strict=True)]
    return out


def hashed_words(column: pa.StringArray, in_word: np.ndarray, key: int = 0) -> list[np.ndarray]:
    """Hashes of the words of each text; in_word tells which bytes words consist of. Null has no words."""
    return hashed_under(column, in_word, [key])[0]


def hashed_under(column: pa.StringArray, in_word: np.ndarray, keys) -> list[list[np.ndarray]]:
    """hashed_words() under each of the keys; words are looked for once."""
    _, offsets, values = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if values is None or not len(column) or at[-1] == at[0]:
        return [[np.zeros(0, np.uint64)] * len(column) for _ in keys]
    raw = np.frombuffer(values, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = in_word[raw]
    after, before = word.copy(), word.copy()
    after[1:], before[:-1] = word[:-1], word[1:]
    after[0] = before[-1] = False
    filled = at[:-1] < at[1:]
    after[at[:-1][filled]] = False  # texts part words
    before[at[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(word & ~after), np.flatnonzero(word & ~before) + 1
    cuts = np.searchsorted(starts, at[1:-1])
    return [np.split(byte_hashes(raw, starts, ends, key), cuts) for key in keys]
