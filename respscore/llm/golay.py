"""The binary Golay code [23, 12, 7] on numpy arrays: every 23-bit word is within three bits of one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, DATA = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at its three places, and the error pattern of each syndrome."""
    parity = BITS - DATA

    def remainder(x: int) -> int:
        for i in range(BITS - 1, parity - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - parity)
        return x

    by_byte = np.array([[remainder((v << (8 * k)) & ((1 << BITS) - 1)) for v in range(256)] for k in range(3)], dtype=np.uint32)
    error = np.zeros(1 << parity, dtype=np.uint32)
    for weight in range(4):
        for at in combinations(range(BITS), weight):
            pattern = sum(1 << i for i in at)
            error[remainder(pattern)] = pattern
    return by_byte, error


_SYNDROME, _ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    w = words.astype(np.uint32)
    syndrome = _SYNDROME[0][w & 255] ^ _SYNDROME[1][(w >> 8) & 255] ^ _SYNDROME[2][w >> 16]
    return (w ^ _ERROR[syndrome]) >> (BITS - DATA)


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near words of ``bits`` bits: (counts per word, flat indices).

    A word of even weight gets the distinct indices of itself and of all words one bit away
    (up to six), a word of odd weight its own only.  Two words at most one bit apart share an
    index: equal ones share their own, and of two that differ in one bit exactly one has even
    weight, whose neighbours include the other."""
    words = words.astype(np.uint32)
    around = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    keys = decode(words[:, None] ^ around[None, :])
    odd = (np.bitwise_count(words) & 1).astype(bool)
    keys[odd] = keys[odd, :1]
    keys.sort(axis=1)
    first = np.ones(keys.shape, dtype=bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return first.sum(axis=1), keys[first].astype(np.int64)
