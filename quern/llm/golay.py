"""The perfect binary Golay code [23, 12, 7], as tables built from its generator polynomial.

Every 23-bit word lies within distance 3 of exactly one codeword. ``near_indices`` names the
codewords near a word: the closest one, and for words at distance 3 also the five at distance 4.
Two words that differ in at most one bit always share one of these names: if x decodes to c at
distance 2 or less, a neighbour decodes to c too; if at distance 3, a neighbour is at distance 2 or 3
(and decodes to c) or at distance 4 (and lists c among its five).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
MESSAGE_BITS = 12
CHECK_BITS = BITS - MESSAGE_BITS
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for shift in range(MESSAGE_BITS - 1, -1, -1):
        if word >> (shift + CHECK_BITS) & 1:
            word ^= GENERATOR << shift
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each bit, errors by syndrome padded to six columns, number of errors by syndrome)."""
    of_bit = np.array([_remainder(1 << bit) for bit in range(BITS)], dtype=np.int64)
    errors = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64)
    counts = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    heavy = np.zeros(1 << CHECK_BITS, dtype=bool)
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= int(of_bit[bit])
            if weight == 3:
                heavy[syndrome] = True
            if weight < 4 or heavy[syndrome]:
                errors[syndrome, counts[syndrome]] = sum(1 << bit for bit in bits)
                counts[syndrome] += 1
    return of_bit, errors, counts


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, codeword indices): one entry per codeword near each word of up to 23 bits."""
    of_bit, errors, counts = tables()
    syndromes = np.zeros(len(words), dtype=np.int64)
    for bit in range(BITS):
        syndromes ^= np.where(words >> bit & 1, of_bit[bit], 0)
    listed = np.arange(errors.shape[1]) < counts[syndromes][:, None]
    indices = (words[:, None] ^ errors[syndromes]) >> CHECK_BITS
    return np.nonzero(listed)[0], indices[listed]
