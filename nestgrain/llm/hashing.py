"""Words, shingles and distinct sets of UTF-8 texts as numpy arrays, a block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
BLOCK = 1 << 20  # bytes hashed at once; also the text bytes handled per numpy pass


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` odd multipliers from a counter."""
    steps = (np.arange(1, n + 1, dtype=U64) + U64(salt << 20)) * U64(GOLDEN)
    return mix(steps) | U64(1)


def _letters() -> np.ndarray:
    table = seeds(256, 7)
    table[65:91] = table[97:123]  # A-Z as a-z
    return table


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


LETTERS, SPACES = _letters(), _spaces()
STEP = GOLDEN | 1
STEP_BACK = pow(STEP, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_chunks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, offsets) for runs of rows of about ``limit`` bytes; a longer row stands alone.

    A null is an empty text.
    """
    filled = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(filled.type) or pa.types.is_large_binary(filled.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(filled)
    if n == 0:
        return
    buffers = filled.buffers()
    offsets = np.frombuffer(buffers[1], kind)[filled.offset : filled.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of every word; words never cross a text border."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[borders - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z folded to a-z."""
    out = np.empty(len(starts), U64)
    step, back = powers(STEP, BLOCK), powers(STEP_BACK, BLOCK)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[stop - 1]
        if high - low > len(step):
            step, back = powers(STEP, int(high - low)), powers(STEP_BACK, int(high - low))
        total = np.zeros(high - low + 1, U64)
        np.cumsum(LETTERS[data[low:high]] * step[: high - low], out=total[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (total[e] - total[s]) * back[s] + (e - s).astype(U64)
        at = stop
    return mix(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; entry i starts at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for j in range(1, width):
        out *= U64(STEP)
        out += words[j : j + n]
    return mix(out)


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes per text.

    Fewer words than ``width`` count as one shingle of all of them; no words give an empty set.
    """
    starts, ends = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = shingle_hashes(words, width)
    bounds = np.searchsorted(starts, offsets)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield shingle_hashes(words[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)


def sequences_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Shingle hashes per text in text order, repeats kept; short texts as in ``sets_of``."""
    starts, ends = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = shingle_hashes(words, width)
    bounds = np.searchsorted(starts, offsets)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            yield runs[a : b - width + 1]
        elif b > a:
            yield shingle_hashes(words[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)
