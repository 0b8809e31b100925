"""64-bit hashes of the words of a text, for whole texts at a time.

A word's hash is a polynomial of its bytes, read off running sums, then mixed;
all steps are array operations. Two different words share a hash with a chance of
about 2 to the power of -64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LETTER = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # BASE to the k, and its inverse to the k

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Anything but ASCII letters, digits and the bytes of other characters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            POWERS[k] = np.multiply.accumulate(out)
    return POWERS[0][:n], POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def word_hashes(raw: bytes, gap: np.ndarray = WHITE) -> np.ndarray:
    """Hashes of the runs of bytes outside ``gap``, in order."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) == 0:
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], gap[b], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[b] * up[:-1], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SHINGLE = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_set(raw: bytes, size: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of the ``size``-word shingles of the text with A-Z in lower case.

    A text of fewer words is one shingle; without words there is none.
    """
    h = word_hashes(raw.lower())
    if len(h) == 0:
        return h
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, U(width), np.uint64)
    for k in range(width):
        total = total + h[k : len(h) - width + 1 + k] * U(SHINGLE[k])
    return np.unique(mix(total))
