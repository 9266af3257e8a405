"""The binary Golay code of length 23: keys that near 23-bit words share.

Every 23-bit word is within distance 3 of exactly one codeword. Two words at distance 2 or less
have a word between them that is within 1 of both; its codeword is within 4 of both. So the
codewords within distance 4 of a word, as 12-bit indices, are keys of which near words share one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
# The generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1; the remainder by it is a word's syndrome.
GENERATOR = 0b101011100011
RADIUS = 4


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - (LENGTH - DATA))), rest)
    return rest


@cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, its error patterns of weight 4 or less: (patterns, how many)."""
    words = np.array([sum(1 << b for b in c) for w in range(RADIUS + 1) for c in combinations(range(LENGTH), w)])
    which = syndromes(words)
    order = np.argsort(which, kind="stable")
    counts = np.bincount(which, minlength=1 << (LENGTH - DATA))
    table = np.full((len(counts), counts.max()), -1, dtype=np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[which[order], place] = words[order]
    return table, counts


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each word, a row per word; -1 fills the rows.

    The code is systematic, so a codeword's upper 12 bits are its index.
    """
    table, _ = error_patterns()
    errors = table[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> (LENGTH - DATA))
