"""Suffix arrays on numpy by the difference cover of three (positions 1 and 2 modulo 3)."""

from __future__ import annotations

import numpy as np


def _names(columns: list[np.ndarray], top: int) -> tuple[np.ndarray, int]:
    """Dense ranks (from 1) of rows of up to three columns with values up to ``top``, and how many there are."""
    key = columns[0].astype(np.int64)
    bound = top + 1
    for c in columns[1:]:
        if bound * (top + 1) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key = key * (top + 1) + c
        bound *= top + 1
    values, key = np.unique(key, return_inverse=True)
    return key + 1, len(values)


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """Starts of all suffixes of ``s`` (integers 1 to ``top``) in order; a shorter prefix comes first."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a sample past the end keeps the halves apart
    cover = np.concatenate([one, two])

    # sort the sampled triples; if they are not all different, sort the string of their names
    names, different = _names([t[cover], t[cover + 1], t[cover + 2]], top)
    if different < len(cover):
        order = suffix_array(names, different)
        names = np.empty(len(cover), np.int64)
        names[order] = np.arange(1, len(cover) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = names
    sample = cover[np.argsort(names)]
    sample = sample[sample < n]

    # the rest by one character and the rank behind it
    width = len(cover) + 2
    zero = np.arange(0, n, 3)
    zero_key = t[zero].astype(np.int64) * width + rank[zero + 1]
    by = np.argsort(zero_key)
    zero, zero_key = zero[by], zero_key[by]

    # merge: how many sampled suffixes come before each of the rest
    ones = sample[sample % 3 == 1]
    before_one = np.searchsorted(t[ones].astype(np.int64) * width + rank[ones + 1], zero_key)
    both = np.zeros(n + 3, np.int64)  # ranks among positions 0 and 1 modulo 3, where two compares with zero
    both[zero] = np.arange(1, len(zero) + 1) + before_one
    place = np.ones(len(zero) + len(ones), bool)
    place[both[zero] - 1] = False
    both[ones] = np.flatnonzero(place) + 1
    twos, wide = sample[sample % 3 == 2], len(place) + 2
    before_two = np.searchsorted(t[twos].astype(np.int64) * wide + both[twos + 1], t[zero].astype(np.int64) * wide + both[zero + 1])
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + before_one + before_two
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sample
    return out
