"""Words, lines and shingles of texts as NumPy arrays over their UTF-8 bytes.

Hashes are 64-bit, the same in every process, and computed for all words of a block at once:
bytes are weighted with powers of an odd number modulo 2**64, prefix sums give the weighted
sum of any range, and the inverse power moves it to the origin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 0x9E3779B97F4A7C15
INVERSE = pow(STEP, -1, 1 << 64)
#: Bytes that one pass of hashing holds at most, and of the texts that form a block.
SLICE, BLOCK = 1 << 20, 1 << 21

#: The bytes that separate words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


PLAIN = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
#: Byte codes that read A-Z as a-z.
LOWER = PLAIN.copy()
LOWER[65:91] = PLAIN[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(STEP, SLICE + 1), _powers(INVERSE, SLICE + 1)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = PLAIN) -> np.ndarray:
    """Hashes of ``data[start:end]`` for ascending ranges that do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(ends, first + SLICE, "right"))
        if j <= i:  # one range longer than a slice: add up its pieces
            total, shift = 0, 1
            for at in range(int(first), int(ends[i]), SLICE):
                piece = data[at : min(at + SLICE, int(ends[i]))]
                total += int((codes[piece] * _UP[: len(piece)]).sum(dtype=np.uint64)) * shift
                shift = shift * pow(STEP, SLICE, 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        sums = np.zeros(int(ends[j - 1] - first) + 1, np.uint64)
        np.cumsum(codes[data[first : ends[j - 1]]] * _UP[: len(sums) - 1], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - first] - sums[starts[i:j] - first]) * _DOWN[starts[i:j] - first]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(STEP))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column: ``(first row, bytes, offsets)``; null texts are empty.

    A block holds ``limit`` bytes, or a single longer text.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def pieces(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not ``cut``, never across texts.

    Returns ``(first, starts, ends)``: text ``t`` owns the runs ``first[t]:first[t + 1]``.
    """
    inside = ~cut[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = ~inside
    before[offsets] = True
    starts = np.flatnonzero(inside & before[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = ~inside
    after[offsets] = True
    ends = np.flatnonzero(inside & after[1:]) + 1
    return np.searchsorted(starts, offsets), starts, ends


def owners(first: np.ndarray) -> np.ndarray:
    """The text of every run, from the ``first`` of :func:`pieces`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, odd in enumerate(odd_numbers(size, seed)):
        total += hashes[j : j + n] * odd
    return mix(total)


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of ``size`` runs stays in its text."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.arange(n)
    return at[at + size <= np.repeat(first[1:], np.diff(first))[:n]]
