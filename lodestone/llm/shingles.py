"""Sets of word shingles as sorted 64-bit hashes, from UTF-8 bytes, with numpy only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPAN = 64
BLOCK = 2_000_000
SKETCH_BITS = 1024

_draw = np.random.default_rng(20_240_501)
_BYTE = _draw.integers(0, 2**64, (SPAN, 256), dtype=np.uint64)
_BYTE[:, 65:91] = _BYTE[:, 97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, over uint64."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of one text (bytes), in order; in blocks, so that long texts need little more than their words."""
    out, at, n = [], 0, len(data)
    while at < n:
        stop = min(n, at + BLOCK)
        while stop < n and not _SPACE[data[stop]]:  # a word stays whole
            ahead = np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])
            stop = stop + int(ahead[0]) if len(ahead) else min(n, stop + BLOCK)
        b = data[at:stop]
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            size = ends - starts
            where = np.flatnonzero(word)
            first = np.cumsum(size) - size
            inside = np.arange(len(where)) - np.repeat(first, size)
            place = inside % SPAN
            sums = np.add.reduceat(_BYTE.ravel()[place * 256 + b[where]], first if size.max() <= SPAN else np.flatnonzero(place == 0))
            if size.max() > SPAN:
                # each piece is mixed with its number before the pieces of a word are added up
                number = inside[place == 0] // SPAN
                pieces = -(-size // SPAN)
                sums = np.add.reduceat(np.where(number > 0, mix(sums ^ mix(number.astype(np.uint64), 5), 6), sums), np.cumsum(pieces) - pieces)
            out.append(mix(sums ^ size.astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(data: np.ndarray, words: int = 3) -> np.ndarray:
    """Sorted distinct shingles; a text with fewer words is one shingle, one without words none."""
    w = word_hashes(data)
    if len(w) == 0:
        return w
    if len(w) < words:
        h = np.full(1, len(w), np.uint64)
        for x in w:
            h = mix(h ^ x, 1)
        return h
    h = mix(w[words - 1 :], 1)
    for k in range(words - 2, -1, -1):
        h = mix(h ^ w[k : len(w) - words + 1 + k], k + 2)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def key_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    return int(mix(s, 11).sum(dtype=np.uint64).view(np.int64)), int(mix(s, 12).sum(dtype=np.uint64).view(np.int64))


def sketch_of(s: np.ndarray) -> bytes:
    """Parity of the number of members in each of at least 1,024 places, twice as many as members.

    Two sketches differ in at most as many bits as their sets in members. Halves of a sketch, combined by exclusive or, are the
    sketch of half the size.
    """
    bits = max(SKETCH_BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else SKETCH_BITS
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def each_text(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of a string column, without copies; null as empty."""
    col = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1] if offsets is not None and len(col) else np.zeros(1, kind)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    empty = np.zeros(0, np.uint8)
    valid = col.is_valid().to_pylist() if col.null_count else None
    for i in range(len(col)):
        yield empty if valid is not None and not valid[i] else raw[at[i] : at[i + 1]]
