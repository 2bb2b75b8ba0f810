"""Vectorised word and shingle hashing over Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D; only A-Z are
lower-cased.  Everything works on the UTF-8 bytes, so no Python object is made
per word.  Texts are handled in chunks cut at white space, so memory does not
grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``salt`` picks one of many independent functions."""
    h = h + np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _MASK)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)
        _powers.clear()
        _powers[size] = (up, down)
    return _powers[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses one of the offsets ``at``."""
    inside = ~_WS[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(raw))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trimmed(raw: np.ndarray, start: np.ndarray, end: np.ndarray, signs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Words without up to ``signs`` ASCII signs at either end; a word always keeps one byte."""
    for _ in range(signs):
        start = start + ((end - start > 1) & ~_SOLID[raw[start]])
        end = end - ((end - start > 1) & ~_SOLID[raw[end - 1]])
    return start, end


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each word: sums of bytes times powers of
    an odd base, moved to the word's start by the inverse power, then mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    value = (_LOWER[raw] if lower else raw).astype(np.uint64)
    value += np.uint64(1)
    value *= up[: len(raw)]
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def _pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets) of chunks of whole texts; a
    longer text alone comes in several chunks that are cut at white space."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1)
        if at[j] - at[i] <= CHUNK_BYTES:
            yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        else:
            begin, stop = int(at[i]), int(at[i + 1])
            while begin < stop:
                cut = min(stop, begin + CHUNK_BYTES)
                if cut < stop:
                    white = np.flatnonzero(_WS[raw[begin:cut]])
                    if len(white):
                        cut = begin + int(white[-1]) + 1
                    else:
                        after = np.flatnonzero(_WS[raw[cut:stop]])
                        cut = cut + int(after[0]) if len(after) else stop
                yield i, i + 1, raw[begin:cut], np.array([0, cut - begin])
                begin = cut
        i = j


def word_hashes(column: pa.Array, lower: bool = True, bare: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, offsets of texts in them) for runs of whole texts.

    ``bare``: of words without the signs around them; a word of signs alone is none."""
    raw, at = text_bytes(column)
    held: list[np.ndarray] = []
    for i, j, part, offsets in _pieces(raw, at):
        start, end = spans(part, offsets)
        if bare:
            start, end = trimmed(part, start, end)
            solid = _SOLID[part[start]]
            start, end = start[solid], end[solid]
        h = hashes(part, start, end, lower)
        if j == i + 1 and at[j] - at[i] > CHUNK_BYTES:
            held.append(h)
            if _is_last(part, raw, at, j):
                h = np.concatenate(held)
                held = []
                yield i, h, np.array([0, len(h)])
            continue
        yield i, h, np.searchsorted(start, offsets)


def _is_last(part: np.ndarray, raw: np.ndarray, at: np.ndarray, j: int) -> bool:
    """Whether ``part``, a view of ``raw``, ends where text j - 1 ends."""
    end = (part.__array_interface__["data"][0] - raw.__array_interface__["data"][0]) + len(part)
    return end == int(at[j])


def shingle_sets(h: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words;
    a shorter text's whole sequence is its only shingle; no words, no shingles."""
    with np.errstate(over="ignore"):
        factors = [np.uint64(((2 * k + 3) * 0xD6E8FEB86659FD93) & _MASK | 1) for k in range(width)]
        if len(h) >= width:
            g = np.zeros(len(h) - width + 1, np.uint64)
            for k, f in enumerate(factors):
                g += h[k : k + len(g)] * f
            g = mix(g)
        else:
            g = np.zeros(0, np.uint64)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                yield np.unique(g[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(b - a):
                    whole = whole + h[a + k] * factors[k]
                yield mix(np.array([whole], np.uint64), salt=1)
            else:
                yield g[:0]
