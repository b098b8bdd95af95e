"""HyperMinHash registers: per bucket the leading-zero count and the top mantissa bits of the least hash.

A set's hashes are dealt to REGISTERS buckets. Of the least value in a bucket only its number of leading zeros and
MANTISSA bits after the leading one are kept: two bytes. An empty bucket takes the register of another bucket, the
first full one in an order fixed for that bucket, so that small sets have full sketches too and equal registers keep
the probability of the Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from docloom.llm.hashing import mix

MANTISSA = 10


def borrow_order(registers: int) -> np.ndarray:
    """borrow_order[t, j]: the bucket that empty bucket j asks at its t-th try."""
    rng = np.random.default_rng(registers)
    return np.argsort(rng.random((registers, registers)), axis=0)


def least_values(values: np.ndarray, owner: np.ndarray, owners: int, registers: int) -> np.ndarray:
    """A row for each owner with the least 56-bit hash in each bucket; empty buckets have 2**64 - 1.

    values are well mixed 64-bit hashes: their upper half picks the bucket, a multiple of the whole is the value.
    """
    least = np.full(owners * registers, 2**64 - 1, dtype=np.uint64)
    if len(values):
        bucket = ((values >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, owner * registers + bucket, values * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(8))
    return least.reshape(owners, registers)


def borrowed(regs: np.ndarray, full: np.ndarray) -> np.ndarray:
    """regs with every empty bucket filled from a full one of the same row; rows without any stay as they are."""
    registers = regs.shape[1]
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    order, out = borrow_order(registers), regs.copy()
    for t in range(registers):
        if not len(rows):
            break
        source = order[t, cols]
        found = full[rows, source]
        out[rows[found], cols[found]] = regs[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
    return out


def sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """A row of 16-bit registers for each set; sets without members have rows of 0xFFFF."""
    counts = np.fromiter((len(s) for s in sets), dtype=np.int64, count=len(sets))
    values = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    least = least_values(values, np.repeat(np.arange(len(sets)), counts), len(sets), registers)
    full = least != np.uint64(2**64 - 1)
    m, e = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    packed = (57 - e) * (1 << MANTISSA) + ((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return borrowed(np.where(full, packed, 0xFFFF).astype(np.uint16), full)


def bands(regs: np.ndarray, number: int, width: int, first: int = 0) -> np.ndarray:
    """For each sketch `number` keys: 58 bits hashed from `width` registers, then the band's own number, from `first`, in
    6 bits."""
    parts = regs[:, : number * width].reshape(len(regs), number, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, number + 1, dtype=np.uint64), (len(regs), number))
    for k in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return (key & ~np.uint64(63) | np.arange(first, first + number, dtype=np.uint64)).astype(np.int64)


def collision_rate(n_a: float, n_b: float, registers: int) -> float:
    """How often registers of two unrelated sets of these sizes agree: same leading zeros and same mantissa bits."""
    a, b = max(n_a / registers, 1.0), max(n_b / registers, 1.0)
    total = 0.0
    for k in range(57):
        lo, hi = 2.0 ** -(k + 1), 2.0**-k
        pa = math.exp(a * math.log1p(-lo)) - (math.exp(a * math.log1p(-hi)) if k else 0.0)
        pb = math.exp(b * math.log1p(-lo)) - (math.exp(b * math.log1p(-hi)) if k else 0.0)
        total += pa * pb
    return total / (1 << MANTISSA)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, registers: int) -> np.ndarray:
    """Jaccard similarity from shares of equal registers, corrected for registers that agree by accident."""
    rate = {}
    c = np.empty(len(equal))
    for i, key in enumerate(zip(np.log2(np.maximum(n_a, 1)).round().tolist(), np.log2(np.maximum(n_b, 1)).round().tolist(), strict=True)):
        if key not in rate:
            rate[key] = collision_rate(2.0 ** key[0], 2.0 ** key[1], registers)
        c[i] = rate[key]
    return np.clip((equal - c) / (1 - c), 0, 1)


def least_estimate(threshold: float, n: np.ndarray, registers: int, sigmas: float = 4.5) -> np.ndarray:
    """The estimate that a pair at the threshold falls short of only once in some 300,000 times."""
    return threshold - sigmas * np.sqrt(threshold * (1 - threshold) / np.clip(n, 1, registers))
