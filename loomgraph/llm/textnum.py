"""Words and shingles of Arrow text columns as 64-bit numbers, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
        _INVERSES = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
    return _POWERS[:n], _INVERSES[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about `most_bytes` of text, whole texts always."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and (held + n > most_bytes or i - lo >= most_rows):
            yield lo, i - lo
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield lo, len(sizes) - lo


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) of every text in order, and words per text."""
    data, offsets = flat(column)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = inside & (np.concatenate([[True], ~inside[:-1]]) | border[:-1])
    end = inside & (np.concatenate([~inside[1:], [True]]) | border[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    hashes = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text = np.searchsorted(offsets, s, side="right") - 1
    return hashes, np.bincount(text, minlength=len(column))


#: Bits of a shingle's hash; a batch's texts are numbered in the rest of a 64-bit word.
HASH_BITS = 52


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (HASH_BITS bits) of each text, text after text, and how many each has.

    A text of fewer words than `width` has its whole sequence as one shingle, one without
    words has none.  At most 2^12 texts at a time, as `slices` gives them.
    """
    words, per = word_hashes(column)
    ends = np.cumsum(per)
    begins = ends - per
    made = np.where(per >= width, per - width + 1, (per > 0).astype(np.int64))
    text = np.repeat(np.arange(len(per), dtype=np.int64), made)
    short = np.flatnonzero((per > 0) & (per < width))
    first = np.arange(len(text)) + np.repeat(begins - np.cumsum(made) + made, made)
    h = np.full(len(text), width, np.uint64)
    for j in range(width):
        h = mix(h * _BASE + words[np.minimum(first + j, max(len(words) - 1, 0))]) if len(text) else h
    at = np.cumsum(made) - made
    for i in short.tolist():  # fewer words than a shingle
        one = np.full(1, per[i], np.uint64)
        for w in words[begins[i] : ends[i]]:
            one = mix(one * _BASE + w)
        h[at[i]] = one[0]
    # text and hash in one number: a plain sort then does both
    packed = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    packed.sort()
    packed = packed[np.diff(packed, prepend=~packed[:1]) != 0]
    return packed & np.uint64((1 << HASH_BITS) - 1), np.bincount((packed >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(per))


def set_digests(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers that tell the sets apart; 0, 0 for empty ones."""
    out = np.zeros((len(per), 2), np.uint64)
    some = np.flatnonzero(per)
    if len(some):
        at = (np.cumsum(per) - per)[some]
        out[some, 0] = mix(np.add.reduceat(mix(hashes), at))
        out[some, 1] = mix(np.bitwise_xor.reduceat(mix(hashes ^ _BASE), at) + per[some].astype(np.uint64))
    return out
