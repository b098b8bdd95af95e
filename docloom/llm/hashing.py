"""Vectorised 64-bit hashing of words and byte grams with numpy, for use inside Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 19

#: A random 64-bit value for each byte.
BYTE = np.random.default_rng(20_24).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stir(x: np.ndarray) -> np.ndarray:
    """A cheaper bijection, for sums of polynomials, whose upper bits are good already."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tidied(batches: Iterator) -> Iterator:
    """The batches; after the last one, memory that Python's allocators hold back goes to the system.

    Workers wait for further tasks beside an executor's heap, so what each keeps counts.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that what Python holds at a time stays small."""
    for batch in tidied(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text has a range of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def power_tables(n: int = CHUNK + (CHUNK >> 3)) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of BASE and of its inverse, for a task to compute once."""
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        powers = np.ones(n + 1, dtype=np.uint64)
        np.cumprod(np.full(n, base, dtype=np.uint64), out=powers[1:])
        out.append(powers)
    return out[0], out[1]


def prefix_sums(values: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What range_hashes needs: running sums of a polynomial in BASE, and the inverse powers that align them."""
    n = len(values)
    powers, inverse = tables if tables is not None and len(tables[0]) > n else power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers[:n], out=sums[1:])
    return sums, inverse[: n + 1]


def range_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hash of each range; equal contents have equal hashes wherever they stand."""
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def words(texts: list[bytes], is_word: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and how many words each text has. `is_word` says which bytes make words."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    inside = is_word[buf]
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = inside[0]
    edges = np.flatnonzero(edge)
    starts, stops = edges[::2], edges[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    upto = np.searchsorted(starts, ends)
    return range_hashes(*prefix_sums(BYTE[buf], tables), starts, stops), np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], size: int, is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words.

    A text of fewer words, but not none, has one shingle: all of them. A text of no words has none.
    """
    out: list[np.ndarray] = []
    tables = power_tables() if sum(map(len, texts)) > CHUNK else None
    for a, b in chunks(texts):
        h, counts = words(texts[a:b], is_word, tables)
        grams = h.copy()
        for k in range(1, size):
            grams[: len(h) - k] = mix(grams[: len(h) - k] * np.uint64(BASE) + h[k:])
        at = 0
        for n in counts.tolist():
            if n >= size:
                own = grams[at : at + n - size + 1].copy()
                own.sort()
                keep = np.ones(len(own), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            elif n:
                one = h[at]
                for x in h[at + 1 : at + n]:
                    one = mix(np.array([one], dtype=np.uint64) * np.uint64(BASE) + x)[0]
                out.append(mix(np.array([one], dtype=np.uint64) + np.uint64(n)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += n
    return out


def set_key(values: np.ndarray) -> bytes:
    """Sixteen bytes that name a set of hashes whatever its order."""
    if not len(values):
        return b""
    a = int(values.sum(dtype=np.uint64))
    b = int(mix(values + np.uint64(len(values))).sum(dtype=np.uint64))
    return a.to_bytes(8, "little") + b.to_bytes(8, "little")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
