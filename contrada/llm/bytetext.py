"""Numpy kernels over the bytes of an Arrow string column: words, hashes and shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, the rest as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are worked on in pieces of whole documents of about so many bytes.
CHUNK_BYTES = 1 << 19
#: The same for shingles, whose hashes are wide: these stay in the processor's cache.
SHINGLE_BYTES = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every bit (the constants are those of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string or binary column; a null has no bytes."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(col: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets from 0) of runs of whole documents of about `size` bytes; one long document is a run of its own."""
    raw, offsets = column_bytes(col)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (size or CHUNK_BYTES), "right")) - 1)
        end = min(end, len(col))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (n + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial prefix sums, moved to the origin and mixed with the length."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within documents, and the first of each document (n + 1 numbers). A document of 1 to k - 1 words has its whole sequence as its only shingle."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(int(starts[-1]), np.uint64)
    doc = np.repeat(np.arange(len(counts)), n)
    at = first[:-1][doc] + np.arange(len(out)) - starts[:-1][doc]
    length = np.minimum(counts, k)[doc]
    for j in range(k):
        have = length > j
        term = np.zeros(len(out), np.uint64)
        term[have] = word[at[have] + j]
        out = mixed(out + term + np.uint64(j + 1) * np.uint64(0xA0761D6478BD642F)) if j == 0 else mixed(out * np.uint64(0xE7037ED1A0B428DB) + term)
    return out ^ length.astype(np.uint64), starts


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text, after lower-casing A-Z."""
    for at, end, data, offsets in chunks(col, min(CHUNK_BYTES, SHINGLE_BYTES)):
        data = LOWER[data]
        s, e, first = words(data, offsets)
        hashes, starts = shingle_hashes(span_hashes(data, s, e), first, k)
        for i in range(end - at):
            own = hashes[starts[i] : starts[i + 1]]
            if len(own) > 1:
                # np.unique costs three times as much on sets of this size.
                own = np.sort(own)
                new = own[1:] != own[:-1]
                own = own if new.all() else own[np.concatenate(([True], new))]
            yield at + i, own
