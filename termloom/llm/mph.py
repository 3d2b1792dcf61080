"""Minimal perfect hashing of a set of keys: one displacement per small bucket of keys.

``build`` finds, for every bucket in order of falling size, the first displacement that
sends its keys to free slots; single keys take the free slots that remain.  ``slot`` is
constant-time: two hashes of the key and one displacement.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Average number of keys that share a displacement.
BUCKET_KEYS = 2


def key_hashes(key: bytes) -> tuple[int, int, int, int]:
    """Bucket hash, two slot hashes and the fingerprint."""
    h = int.from_bytes(hashlib.blake2b(key, digest_size=16).digest(), "little")
    mask = 0xFFFFFFFF
    return h & mask, h >> 32 & mask, h >> 64 & mask, h >> 96


def spot(one: int, two: int, d: int, n: int) -> int:
    """The slot that displacement ``d`` gives a key with slot hashes ``one`` and ``two``."""
    x = ((one << 32 | two) ^ d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x >> 24) % n


def _spots(mixed: np.ndarray, d: int, n: int) -> np.ndarray:
    """:func:`spot` of many keys, their slot hashes joined in one number."""
    x = mixed ^ np.uint64(d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def build(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and the fingerprint at each slot; keys must differ.

    All buckets of one size try a displacement together; of those that want the same slot the
    first one gets it.
    """
    n = len(keys)
    if len(set(keys)) < n:
        raise ValueError("no displacement found: keys repeat")
    n_buckets = max(1, -(-n // BUCKET_KEYS))
    hashed = np.array([key_hashes(k) for k in keys], np.uint64).reshape(n, 4)
    mixed, marks = hashed[:, 1] << np.uint64(32) | hashed[:, 2], hashed[:, 3].astype(np.uint32)
    bucket = (hashed[:, 0] % np.uint64(n_buckets)).astype(np.int64)
    members, held = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=n_buckets)
    first = np.cumsum(held) - held
    shift = np.zeros(n_buckets, np.int32)
    prints = np.zeros(n, np.uint32)
    taken = np.zeros(n, bool)
    claim = np.zeros(n, np.int64)
    for size in range(int(held.max(initial=0)), 1, -1):
        own = np.flatnonzero(held == size)
        rows = members[first[own][:, None] + np.arange(size)]
        d = 0
        while len(own):
            at = _spots(mixed[rows], d, n)
            free = (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1) & ~taken[at].any(axis=1)
            wanted = np.flatnonzero(free)
            # the last of the writes to a slot counts, so the buckets are written backwards
            claim[at[wanted[::-1]]] = wanted[::-1, None]
            placed = wanted[(claim[at[wanted]] == wanted[:, None]).all(axis=1)]
            shift[own[placed]] = d
            taken[at[placed]] = True
            prints[at[placed]] = marks[rows[placed]]
            left = np.ones(len(own), bool)
            left[placed] = False
            own, rows, d = own[left], rows[left], d + 1
            if d > 1 << 24:
                raise ValueError("no displacement found")
    # single keys get a direct slot, told apart by its sign
    own, free = np.flatnonzero(held == 1), np.flatnonzero(~taken)
    shift[own] = -free - 1
    prints[free] = marks[members[first[own]]]
    return shift, prints


def slot(key: bytes, shift: np.ndarray, prints: np.ndarray) -> int:
    """The slot of a key, or -1 if the fingerprint shows that it is not in the set."""
    n = len(prints)
    if not n:
        return -1
    bucket, one, two, mark = key_hashes(key)
    d = int(shift[bucket % len(shift)])
    at = -d - 1 if d < 0 else spot(one, two, d, n)
    return at if int(prints[at]) == mark else -1
