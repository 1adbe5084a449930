"""Word shingles of texts as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are hashed together; a longer text is taken alone.
CHUNK = 1 << 20

_RANDOM = np.random.default_rng(20240917)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)
_WHITE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)], dtype=bool)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64; they are kept and extended."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n+1 offsets into them; null has none."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text of a chunk.

    A text with fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    rows = len(offsets) - 1
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    if not len(raw):
        return [np.zeros(0, dtype=np.uint64)] * rows
    ink = ~_WHITE[raw]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    opens, closes = np.ones(len(raw), dtype=bool), np.ones(len(raw), dtype=bool)
    opens[1:] = ~ink[:-1]
    opens[filled] = True
    closes[:-1] = ~ink[1:]
    closes[filled[1:] - 1] = True
    start, end = np.flatnonzero(ink & opens), np.flatnonzero(ink & closes) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    word = mixed((sums[end] - sums[start]) * down[start])
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    long = max(len(word) - words + 1, 0)
    shingle = np.zeros(long, dtype=np.uint64)
    for place in range(words):
        shingle += word[place : place + long] * _PLACES[place]
    shingle = mixed(shingle)
    out = []
    for i in range(rows):
        a, n = first[i], count[i]
        if n >= words:
            out.append(np.unique(shingle[a : a + n - words + 1]))
        elif n:
            whole = (word[a : a + n] * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
