"""Words and shingles of whole texts as 64-bit hashes, a few MB of text at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one round of array work takes, so that memory does not follow the batch size.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte, the same for both cases of a letter and 0 for white space.
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_CODE[_SPACE] = 0
_STEPS = [_U(x) for x in _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)]
_powers: dict[str, np.ndarray] = {}
#: Where the C library has it, gives freed pages back to the system.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory of a Python worker, at the end of a task: the worker lives on and stands beside what later stages hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1024), _U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK_BYTES + 1024:
            _powers[kind] = have
    return have[:n]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text; a longer text comes alone. Null texts are empty. Freed memory goes back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        batch = batch.set_column(at, text, pc.fill_null(batch.column(at), ""))
        sizes = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the n+1 offsets into them."""
    n = len(column)
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased, and the n+1 offsets of each row's words."""
    data, offsets = raw_bytes(column)
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    sums = np.add.reduceat(_CODE[data] * _power("up", _BASE, len(data)), starts)
    return mix(sums * _power("down", _INVERSE, len(data))[starts]), np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; a row with fewer words gives its whole sequence, one without words nothing."""
    total = np.zeros(max(0, len(hashes) - width + 1), _U)
    for k in range(width):
        total += hashes[k : k + len(total)] * _STEPS[k]
    total = mix(total)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            own = np.sort(total[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            short = np.array([b - a], _U)
            for k in range(b - a):
                short = mix(short * _STEPS[7] + hashes[a + k : a + k + 1])
            yield short
        else:
            yield total[:0]
