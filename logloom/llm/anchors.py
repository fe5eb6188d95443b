"""Anchors: positions that equal byte strings of a given length choose alike, wherever they are."""

from __future__ import annotations

import numpy as np

from logloom.llm.textvec import M1, mix, prefix_hash, span_hash

#: Bytes of the strings among which a window's anchor is the one with the least hash.
GRAM = 32


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for all i, in time that doesn't depend on w."""
    n = len(x)
    rows = -(-n // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = x
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(offsets: np.ndarray, data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows of `length` bytes that share an anchor: (text, h, c, lo, hi).

    Windows start at lo..hi (counted from the chunk's start) and stay inside
    one text. h hashes the anchor, c all bytes from lo to hi + length with the
    anchor's place among them. Equal windows have equal h, and the anchor at
    the same place, since a window's choice depends on its own bytes alone.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length:
        return none
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(sums, at, at + gram)
    chosen = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    anchor = (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    if not len(text):
        return none
    start = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(room) - room), room)
    a = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    last = np.concatenate([first[1:], [len(a)]]) - 1
    lo, hi, a = start[first], start[last], a[first]
    c = mix(span_hash(sums, lo, hi + length) + (a - lo).astype(np.uint64) * np.uint64(M1))
    return text[first], h[a], c, lo, hi
