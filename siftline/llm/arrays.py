"""Vectorised text primitives for Arrow batches inside Spark tasks.

Every helper works on whole texts.  Nulls count as empty texts.  A batch is cut
into slices of about ``SLICE_BYTES`` of text so that the working arrays stay
small; a single text longer than that forms a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GEN = 0xD1342543DE82EF95
_GEN_INV = pow(_GEN, -1, 1 << 64)

#: ASCII white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Maps A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Codes of a second hash of the same span, drawn apart from the first ones.
CHECK_CODES = np.random.default_rng(20250311).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[int, np.ndarray] = {}


def release() -> None:
    """Give memory back to the machine at a task's end, as idle workers stay next to later stages."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words so that all output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per worker up to one slice."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), U(base))
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, nulls as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each part holds about SLICE_BYTES of text."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.diff(utf8(column)[1])
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each row."""
    n = len(data)
    solid = ~space[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal spans in any batch; other codes of the bytes give another hash."""
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(codes[data] * powers(_BASE, n), out=total[1:])
    spans = (total[ends] - total[starts]) * powers(_BASE_INV, n + 1)[starts]
    return mix(spans ^ ((ends - starts).astype(U) * U(0xA24BAED4963EE407)))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive items; item i starts window i."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * powers(_GEN, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_GEN_INV, n)[: n - k + 1] + U(k))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of item runs of any length; equal to window_hashes where lengths agree."""
    n = len(hashes)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * powers(_GEN, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_GEN_INV, n + 1)[starts] + (ends - starts).astype(U))


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k items, over rows of ``counts`` items, stay inside one row."""
    n = int(counts.sum())
    if n < k:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return left[: n - k + 1] >= k
