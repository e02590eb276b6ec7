"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of bit vectors.

Every 23-bit vector lies within distance 3 of exactly one codeword.  A vector's keys are the index of its own codeword
and those of its 23 neighbours' codewords - one key in all when it lies within distance 2 of its codeword, else six.
Two vectors that differ in one bit share a key for certain: each one's own codeword is among the other's keys.  Most pairs that differ in two bits share one too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

N, CHECK = 23, 11
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(v: int) -> int:
    for bit in range(N - 1, CHECK - 1, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - CHECK)
    return v


#: Remainder of each value of the 12 upper bits, and the error pattern of each remainder.
_HIGH = np.array([_remainder(v << CHECK) for v in range(1 << (N - CHECK))], np.int32)
_ERROR = np.zeros(1 << CHECK, np.int32)
for _weight in range(4):
    for _bits in combinations(range(N), _weight):
        _e = sum(1 << b for b in _bits)
        _ERROR[_remainder(_e)] = _e


def index(v: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit vector."""
    v = v.astype(np.int32)
    return (v ^ _ERROR[_HIGH[v >> CHECK] ^ (v & ((1 << CHECK) - 1))]) >> CHECK


def keys(v: np.ndarray, bits: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(position in v, key) of all keys of vectors that use the lower `bits` bits."""
    all_ = np.stack([index(v), *(index(v ^ (1 << b)) for b in range(bits))], axis=1)
    all_.sort(axis=1)
    new = np.ones(all_.shape, bool)
    new[:, 1:] = all_[:, 1:] != all_[:, :-1]
    at = np.nonzero(new)
    return at[0], all_[at]
