"""Arrow text columns as flat byte arrays, and hashes over them.

Tasks work on the UTF-8 bytes of a record batch in slices of bounded size; a text
that is longer than a slice stands alone.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 1 << 20  # bytes handled at a time


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int):
    """Consecutive row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: spreads uint64 values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


#: Bytes of the words of this subpackage: digits, a-z once A-Z is lower-cased, and all of UTF-8 beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.array([1] + [b] * (size - 1), np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and 64-bit hash of each word of each row; equal words have equal hashes anywhere."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = IS_WORD[low]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)] if len(cuts) else cuts
    if len(cuts):  # a word at a row's end touching one at the next row's start
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return rows, starts, ends, hashes


def part(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row (null for a null id)."""
    return F.crc32(F.col(id_column).cast("string")) % modulus
