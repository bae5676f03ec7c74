"""The binary Golay code of length 23: every word lies within three bits of one codeword."""

from __future__ import annotations

import functools
import itertools

import numpy as np

# Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, MESSAGE = 23, 12
SEVERAL = 6


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the words modulo the generator: 11 bits."""
    rest = words.astype(np.int64)
    for i in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        rest = np.where(rest >> i & 1, rest ^ (GENERATOR << (i - LENGTH + MESSAGE)), rest)
    return rest


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bytes at three places, the error of each syndrome, and for errors of
    three bits the five codewords of weight seven that contain them."""
    by_byte = np.stack([syndrome(np.arange(256) << s) for s in (0, 8, 16)])
    error = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
    for weight in range(4):
        for places in itertools.combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            error[syndrome(np.array([e]))[0]] = e
    message = np.arange(1 << MESSAGE, dtype=np.int64) << (LENGTH - MESSAGE)
    codewords = message ^ syndrome(message)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    five = np.full((len(error), SEVERAL - 1), -1, np.int64)
    for s, e in enumerate(error.tolist()):
        if e.bit_count() == 3:
            five[s] = sevens[(sevens & e) == e]
    return by_byte, error, five


def keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each 23-bit word, -1 beyond their number:
    one where the word is within two bits of a codeword, six where it is three off.

    Two words that differ in at most two bits have an index in common. If they decode to different
    codewords, their distances to them add up to five at least. Where one of them is two off, the
    other's codewords within four include that codeword. Where both are three off, two codewords
    of weight seven around the one error lie within four of the other word too.
    """
    by_byte, error, five = _tables()
    w = words.astype(np.int64)
    s = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
    nearest = w ^ error[s]
    more = np.where(five[s] >= 0, nearest[:, None] ^ five[s], -1)
    out = np.concatenate([nearest[:, None], more], axis=1)
    return np.where(out >= 0, out >> (LENGTH - MESSAGE), -1)
