"""Words and shingles of many texts at once, on the UTF-8 buffers of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; one longer text is taken alone.
CHUNK_BYTES = 1 << 19
M1, M2, M3, BASE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(M2)
    x ^= x >> np.uint64(27)
    x *= np.uint64(M3)
    x ^= x >> np.uint64(31)
    return x


#: A random number for every byte value, so that a polynomial over them hashes well.
BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(M1))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n; those of an ordinary chunk are remembered."""
    if n > CHUNK_BYTES + 1:
        return _powers_of(BASE, n), _powers_of(pow(BASE, -1, 1 << 64), n)
    if not _powers:
        _powers["up"], _powers["down"] = (_powers_of(x, CHUNK_BYTES + 1) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return _powers["up"][:n], _powers["down"][:n]


def _powers_of(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of data[i:j], times BASE ** i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each pair, equal for equal bytes wherever they are."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64) * np.uint64(M1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], body


def chunks(offsets: np.ndarray, data: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their offsets from 0, their bytes), in pieces of about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words (A-Z only; `[^\\x20\\x09-\\x0D]+`), and where each text's begin (texts + 1 numbers)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = ink[begins]  # a text's first byte never goes on with the text before
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    ends = begins[1:] - 1
    last[ends] = ink[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix_hash(LOWER[data]), start, end), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of k words in text order, and bounds.

    A text with fewer words has the whole sequence as its one shingle; a text without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(to[-1]) + np.repeat(bounds[:-1] - to[:-1], count)
    end = np.repeat(bounds[1:], count)
    out = np.full(len(at), np.uint64(k), np.uint64)
    for j in range(k):
        there = at + j < end
        part = hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.uint64)
        out = np.where(there, mix(out * np.uint64(M1) + part + np.uint64(j + 1)), out)
    return out, to


def sorted_set(x: np.ndarray) -> np.ndarray:
    """np.unique, quicker."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
