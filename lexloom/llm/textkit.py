"""Vectorised work on the bytes of many texts at once.

Texts arrive as Arrow string columns.  Their UTF-8 bytes stay where they are;
words, lines, shingles and windows are positions into them.  A slice's hash is
multilinear: each byte times a random key of its place in the slice (an
almost universal family, without the collisions that polynomials modulo 2^64
have for every base).  Runs of words are hashed by doubling, with a mix that
isn't linear after every step.  All white space that counts
(``[\\x20\\x09-\\x0D]``) is ASCII and therefore safe to find in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: Seeds of two independent families of keys.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
WORD_SEEDS = (0xD6E8FEB86659FD95, 0xA0761D6478BD642D)

_codes = np.arange(256)
SPACE = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
SAME = _codes.astype(np.uint8)
#: Everything in ASCII that is neither a letter nor a digit.
MARKS = (_codes < 128) & ~(
    ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))
)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_kept: dict[int, np.ndarray] = {}
#: Keys that a worker keeps for each seed; longer slices have theirs made anew.
KEPT_KEYS = 1 << 16


def place_keys(seed: int, n: int) -> np.ndarray:
    """Random keys of the places ``0..n-1`` of a slice."""
    if seed not in _kept:
        _kept[seed] = _made_keys(seed, KEPT_KEYS)
    return _kept[seed] if n <= KEPT_KEYS else _made_keys(seed, n)


def _made_keys(seed: int, n: int) -> np.ndarray:
    return mix(mix(np.arange(1, n + 1, dtype=U64) * U64(seed)) + U64(seed))


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, where, data = array.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(where, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 2 * BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches so that each piece has few bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = column(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def spans(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of its first word."""
    solid = ~gaps[buf]
    n = len(solid)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def slice_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray = SAME, which: int = 0) -> np.ndarray:
    """Hash of each slice ``buf[s:e]``; slices are in order and don't overlap."""
    out = np.empty(len(s), U64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
        a, size = s[i:j], e[i:j] - s[i:j]
        ends = np.cumsum(size)
        n = int(ends[-1])
        keys = place_keys(SEEDS[which], int(size.max()))
        place = np.arange(n) - np.repeat(ends - size, size)
        data = buf[int(a[0]) : int(e[j - 1])]
        if n != len(data):
            data = data[place + np.repeat(a - a[0], size)]
        total = np.zeros(n + 1, U64)
        np.cumsum((fold[data].astype(U64) + U64(1)) * keys[place], out=total[1:])
        out[i:j] = mix((total[ends] - total[ends - size]) + size.astype(U64) * U64(SEEDS[1 - which]))
        i = j
    return out


def same_bytes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether ``buf[s:e]`` and ``other[at:end]`` are the same bytes, for each pair of slices."""
    same = (e - s) == (end - at)
    rows = np.flatnonzero(same)
    i = 0
    while i < len(rows):
        size = (e - s)[rows[i:]]
        j = i + max(1, int(np.searchsorted(np.cumsum(size), BLOCK, "right")))
        r, size = rows[i:j], size[: j - i]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        bad = np.flatnonzero(buf[place + np.repeat(s[r], size)] != other[place + np.repeat(at[r], size)])
        same[r[np.searchsorted(ends, bad, "right")]] = False
        i = j
    return same


def windows(words: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they are of one text.

    A run of twice the words is mixed from its two halves; where k isn't a
    power of two, the last step's halves overlap.
    """
    n = len(words)
    ok, out = np.zeros(n, bool), np.zeros(n, U64)
    if n < k:
        return out, ok
    seed, have = U64(WORD_SEEDS[which]), 1
    h = mix(words + seed)
    while have < k:
        step = min(have, k - have)
        h = mix(h[:-step] * seed + h[step:] + U64(step))
        have += step
    out[: n - k + 1] = mix(h + U64(k))
    count = np.diff(first)
    end = np.repeat(first[1:], count)
    ok = np.arange(n) + k <= end
    return out, ok


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``x[i : i + width]``, shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def set_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int, whole_if_short: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each text, A-Z lower-cased.

    A text with fewer words has its whole sequence as the only shingle, or
    none if ``whole_if_short`` is false; a text without words has none.
    """
    s, e, first = spans(buf, off)
    words = slice_hashes(buf, s, e, LOWER)
    h, _ = windows(words, first, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            yield np.unique(h[a : b - k + 1])
        elif n and whole_if_short:
            yield windows(words[a:b], np.array([0, n]), n)[0][:1]
        else:
            yield np.zeros(0, U64)


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
