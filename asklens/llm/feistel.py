"""A keyed permutation of 0 .. n-1: a Feistel network with cycle-walking."""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 6
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def round_keys(key: str) -> list[int]:
    """One 64-bit key for each round."""
    made = hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest()
    return [int.from_bytes(made[8 * k:8 * k + 8], "big") for k in range(ROUNDS)]


def _mixed(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return (x ^ (x >> np.uint64(31))) & mask


def permuted(places: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """Where the permutation of 0 .. n-1 named by ``key`` takes each place (``back``: where it comes from).

    The network permutes the next even power of two of bits, less than four times ``n``; results outside
    go through it again until they fall inside, which keeps it a permutation of 0 .. n-1.
    """
    bits = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    shift, mask, keys = np.uint64(bits), np.uint64((1 << bits) - 1), round_keys(key)
    out = np.array(places, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        if back:
            for k in reversed(keys):
                left, right = right ^ _mixed(left, k, mask), left
        else:
            for k in keys:
                left, right = right, left ^ _mixed(right, k, mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)
