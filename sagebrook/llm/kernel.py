"""Vectorised text kernels: words and hashes over the raw bytes of an Arrow column.

All arithmetic is modulo 2**64 on numpy arrays, so equal byte strings get equal hashes on
every executor and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 18

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([seed], dtype=U64)))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_VALUE = stream(11, 256) | U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); grown on demand and kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.empty(size, dtype=U64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            factor = U64(pow(base, filled, 2**64))
            have[filled : filled + step] = have[:step] * factor
            filled += step
        if size > SLICE_BYTES + 1:
            return have[:n]
        _powers[base] = have
    return have[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, bytes, offsets) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        lo, hi = offsets[first], offsets[end]
        yield first, end, raw[lo:hi], offsets[first : end + 1] - lo
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of non-spaces) and, per document, its first word's index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Longer words are hashed by a digest, one by one.
LANES = 4
_LANE_MASK = np.array([2**64 - 1, *[2 ** (8 * k) - 1 for k in range(1, 8)]], dtype=U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Spans of up to 8 * LANES bytes are mixed in eight bytes at a time, and no step is linear
    over the last, so that no algebra of the bytes makes two spans collide; longer ones take
    the first eight bytes of their BLAKE2b digest.
    """
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    short = size <= 8 * LANES
    at = np.flatnonzero(short & (size > 0))
    for lane in range(LANES):
        left = size[at] - 8 * lane
        at, left = at[left > 0], left[left > 0]
        if not len(at):
            break
        part = lanes[starts[at] + 8 * lane] & _LANE_MASK[np.where(left < 8, left, 0)]
        h[at] = mix(h[at] ^ part)
    if not short.all():
        raw = data.tobytes()
        for i in np.flatnonzero(~short).tolist():
            digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest()
            h[i] = U64(int.from_bytes(digest, "little"))
    return h


def count_words(column: pa.Array) -> np.ndarray:
    """Words (runs of non-spaces) of each text."""
    out = np.zeros(len(column), dtype=np.int64)
    for first, end, data, offsets in slices(column):
        _, _, at = word_spans(data, offsets)
        out[first:end] = np.diff(at)
    return out
