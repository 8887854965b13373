"""Words of many texts at once, as NumPy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Of a piece of a batch that is hashed at once, so that the arrays stay small.
PIECE_BYTES = 1 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def byte_class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased, in UTF-8: digits, letters and all beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
#: ``[^\x20\x09-\x0D]``.
UNSPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_BYTE_VALUE = mixed(np.arange(256, dtype=U64) + U64(977))
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: ``hash``, and the first word of each text in ``first`` (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        n = len(data)
        lower = LOWER[data]
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = is_word[data]
        is_first = np.zeros(n + 1, dtype=bool)
        is_first[offsets] = True
        here, last = inside[1:-1], inside[:-2]
        begins = here & (~last | is_first[:-1])
        ends = here & (~inside[2:] | is_first[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        power, inverse = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum(_BYTE_VALUE[lower] * power[:n], out=total[1:])
            self.hash = mixed((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U64))
        self.first = np.searchsorted(self.start, offsets)


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], (offsets[row : end + 1] - offsets[row]).astype(np.int64)
        row = end
