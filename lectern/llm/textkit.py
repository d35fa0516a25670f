"""Vectorised text primitives over Arrow string buffers.

Every function here works on the UTF-8 bytes of many rows at once, so a batch costs a few
numpy passes instead of a Python loop over words. Chunks are bounded in bytes, which bounds a
worker's memory whatever the number of rows in an Arrow batch; one text longer than the bound
is a chunk of its own and is still read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def byte_table(keep) -> np.ndarray:
    """A lookup of 256 booleans from a predicate on byte values."""
    return np.fromiter((bool(keep(b)) for b in range(256)), dtype=bool, count=256)


#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: chr(b).isalnum() if b < 128 else True)
#: Everything but the space and the controls from tab to carriage return.
NON_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(12, int(n - 1).bit_length()), dtype=np.uint64)
        have[1:] = U64(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one 64-bit-offset string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), each of about limit bytes."""
    column = text_array(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes that stay inside their row.

    Returns starts, ends and, for each row and one past the last, the index of its first run.
    """
    inside = keep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, from one prefix sum over the chunk."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * _powers(_INVERSE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_MULT, n + 1)[starts] ^ (ends - starts).astype(np.uint64))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which window_hash gives the hash of any window in constant time."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_INVERSE, len(values)), out=total[1:])
    return total


def window_hash(total: np.ndarray, starts: np.ndarray, size) -> np.ndarray:
    """Hashes of the windows of size values from starts; total is prefix_hash's."""
    starts = np.asarray(starts, dtype=np.int64)
    return mix((total[starts + size] - total[starts]) * _powers(_MULT, len(total))[starts])


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of size items within each row, and the windows' rows."""
    count = np.maximum(0, np.diff(bounds) - size + 1)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count), row


def python_threads() -> None:
    """Arrow's own thread pools off: a task has one core."""
    pa.set_cpu_count(1)
    pa.set_io_thread_count(1)
