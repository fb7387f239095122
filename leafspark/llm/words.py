"""Vectorised word scanning over batches of texts.

Words are maximal runs of "word bytes" of the UTF-8 form after A-Z have been lower-cased; both classes below
are closed over multi-byte sequences, so scanning bytes equals scanning characters. A word's 64-bit hash is a
polynomial over its bytes, taken from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, and bytes hashed at once; a longer word or text just takes its own block.
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 256 << 10

try:
    _libc = ctypes.CDLL(None)
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError, TypeError):  # another C library
    _libc = None

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _class(word: set[int]) -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for b in word:
        out[b] = (b + 32 if 65 <= b <= 90 else b) + 1
    return out


#: Everything but the space and 0x09-0x0D.
NON_SPACE = _class(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: ASCII letters and digits, and whatever lies beyond ASCII.
ALPHANUMERIC = _class({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """hashes, starts and ends (bytes in data) of all words; those of text i are first[i]:first[i + 1]."""

    data: bytes
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def _scan_block(block: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = kind[block]
    edge = np.diff((values != 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _tables(len(block) + 1)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(values * power[: len(block)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def scan(texts: list[bytes | None], kind: np.ndarray) -> Words:
    """Words of the texts; None has none."""
    texts = [t or b"" for t in texts]
    data = b" ".join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    buffer = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(buffer):
        to = min(at + BLOCK_BYTES, len(buffer))
        while to < len(buffer):  # back, or else on, to a byte between words
            gaps = np.flatnonzero(kind[buffer[at:to]] == 0)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(to + BLOCK_BYTES, len(buffer))
        s, e, h = _scan_block(buffer[at:to], kind)
        parts.append((s + at, e + at, h))
        at = to
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def hash_word(word: str, kind: np.ndarray) -> np.uint64:
    return scan([word.encode()], kind).hashes[0]


def release() -> None:
    """Gives freed memory back to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about limit bytes of text each, and those texts as UTF-8; only one slice's texts are
    Python objects at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "left"))), len(column))
            yield batch.slice(at, to - at), column.slice(at, to - at).to_pylist()
            at = to
    release()
