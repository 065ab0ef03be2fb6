"""Fuzzy hash keys from the binary Golay code (23, 12, 7).

The code is perfect: each 23-bit word is within 3 bits of one codeword, whose 12 information bits are the word's index.
Two words at most 2 bits apart have a word within 1 bit of both, so the sets of indices of all words within 1 bit of each
(the "ball", at most 6 indices) meet. For words at most 1 bit apart it is enough that the ones of even weight give their
ball and the ones of odd weight their own index.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits (with leading zeros). If two fingerprints differ in at most
4 bits, then by pigeonhole either

* no segment has more than 2 errors: the triples of ball indices meet (36 bits each), or
* one segment has 3 or 4: the other two have at most one error together, so one is equal and the other within 1 bit
  (a key is the equal segment's bits, and an index of the other).

So they share a key; keys shared by chance are told apart by comparing the fingerprints.

``loose_keys`` are for proposals among pairs that differ in more bits, where no key is certain: one of four blocks of 16 bits is
equal, and one of the two 23-bit segments of the rest has at most 2 errors (28 bits a key, some 40 keys).

Defined results: no fingerprints give no keys; equal fingerprints give equal keys each, none twice for one fingerprint and table.
"""

from __future__ import annotations

import numpy as np

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ones = [_remainder(1 << b) for b in range(23)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for b in range(12):
        low[1 << b : 2 << b] = low[: 1 << b] ^ ones[b]
    for b in range(11):
        high[1 << b : 2 << b] = high[: 1 << b] ^ ones[12 + b]
    errors = np.zeros(1 << 11, np.int32)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                word = (1 << i) | (1 << j) | (1 << k)
                errors[ones[i] ^ (ones[j] * (j > i)) ^ (ones[k] * (k > j))] = word
    return low, high, errors


LOW, HIGH, ERRORS = _tables()


def index(words: np.ndarray) -> np.ndarray:
    """The codeword index of each 23-bit word."""
    syndrome = LOW[words & 0xFFF] ^ HIGH[words >> 12]
    return (words ^ ERRORS[syndrome]) >> 11


def ball(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, m): the indices of all words within 1 bit of each, each once; -1 fills up."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int32)
    found = np.sort(index(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return found[:, : max(1, int((found >= 0).sum(axis=1).max(initial=1)))]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of an array of 64-bit fingerprints."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32) for at, n in SEGMENTS]
    balls = [ball(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    a, b, c = (x.astype(np.int64) for x in balls)
    triple = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    valid = (a >= 0)[:, :, None, None] & (b >= 0)[:, None, :, None] & (c >= 0)[:, None, None, :]
    rows, found = [np.nonzero(valid)[0]], [triple[valid]]
    table = 0
    for y in range(3):
        near = balls[y].astype(np.int64)
        odd = (np.bitwise_count(parts[y]) & 1).astype(bool)
        near[odd] = -1
        near[odd, 0] = index(parts[y][odd])
        row, col = np.nonzero(near >= 0)
        for x in range(3):
            if x != y:
                table += 1
                rows.append(row)
                found.append((table << 57) | (parts[x][row].astype(np.int64) << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(found)


def loose_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of keys that pairs of fingerprints some 10 bits apart often share."""
    rows, found = [], []
    low = lambda bits: np.uint64((1 << bits) - 1)
    for block in range(4):
        at = np.uint64(16 * block)
        exact = ((prints >> at) & low(16)).astype(np.int64)
        below = prints & ((np.uint64(1) << at) - np.uint64(1))
        rest = ((prints >> at >> np.uint64(16)) << at) | below if block < 3 else below
        for half in range(2):
            near = ball(((rest >> np.uint64(23 * half)) & low(23)).astype(np.int32), 23).astype(np.int64)
            row, col = np.nonzero(near >= 0)
            rows.append(row)
            found.append(((2 * block + half) << 57) | (exact[row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(found)
