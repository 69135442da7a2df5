"""Vectorised hashing of words and word shingles over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Words get a polynomial hash over a random byte table modulo
2**64, read from one running sum, so a whole batch of documents is hashed with
a handful of numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = 20240229
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Text bytes hashed together; bounds the temporaries of one numpy pass.
CHUNK_BYTES = 1 << 20


_EXACT = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SHINGLE = np.random.default_rng(_SEED + 1).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows, each of about ``chunk_bytes``.

    A null text counts as empty.  One text longer than the chunk is a chunk of
    its own: no text is cut.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more at the end)."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    first[cut] = word[cut]  # words do not run on from one row into the next
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: list[np.ndarray] = []


def release() -> None:
    """Forget the table of powers."""
    _POWERS.clear()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        up, down = np.full(size, _BASE), np.full(size, _INV)
        up[0] = down[0] = 1
        pair = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if n > 2 * CHUNK_BYTES:
            return pair[0], pair[1]
        _POWERS[:] = pair
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of every word; ``fold`` lower-cases A-Z first."""
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _EXACT)[data] * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row.

    A row with 1 to ``width - 1`` words has its whole word sequence as its one
    shingle; a row without words has the empty set.
    """
    starts, ends, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        grams += words[k : k + n] * _SHINGLE[k]
    grams = mix(grams + np.uint64(width))
    for lo, hi in zip(rows[:-1], rows[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            short = words[lo:hi] * _SHINGLE[: hi - lo]
            yield mix(np.array([short.sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
