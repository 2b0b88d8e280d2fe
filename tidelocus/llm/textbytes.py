"""Numpy helpers that work on the flat UTF-8 buffer of an Arrow string column.

Every function takes whole texts.  A batch is cut into slices of about ``SLICE_BYTES`` between
documents (never inside one), so that the temporary arrays, some 60 bytes for each byte of text,
stay small; the longest single text decides the least memory needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_2 = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of the two word classes used by the operators.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~BLANK
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    found = np.frombuffer(data, np.uint8, size, int(offsets[0])) if data is not None and size else np.zeros(0, np.uint8)
    return found, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = flat(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, cut at documents, and each document's first run (n + 1)."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        back = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, back, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[int(base)] = (np.cumprod(up), np.cumprod(down))
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray, second: bool = False) -> np.ndarray:
    """Running sums of value times a power of its place, from which ``span_hash`` takes differences."""
    up, _ = _powers(len(values) + 1, _BASE_2 if second else _BASE)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of the spans: equal spans have equal hashes wherever they stand."""
    _, down = _powers(len(sums), _BASE_2 if second else _BASE)
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Of eight bytes, read as a little-endian number, the first 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SHORT = 16


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each span as two numbers: with its length they are the whole of a span of up to ``SHORT`` bytes."""
    room = np.append(data, np.zeros(16, np.uint8))
    eight = np.ndarray(len(data) + 8, "<u8", room, strides=(1,))
    size = ends - starts
    low = eight[starts] & _FIRST[np.minimum(size, 8)]
    high = eight[np.minimum(starts + 8, len(data))] & _FIRST[np.clip(size - 8, 0, 8)]
    return low, high


def packed_hash(low: np.ndarray, high: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of packed spans."""
    out = high * _BASE_2
    out += size.astype(np.uint64) + np.uint64(seed)
    out ^= out >> np.uint64(32)
    out *= _BASE
    out += low
    return _mix(out * _BASE)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words: of the packed bytes of short ones, XXH3 of longer ones."""
    size = ends - starts
    out = packed_hash(*packed(data, starts, ends), size, seed)
    far = np.flatnonzero(size > SHORT)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        out[far] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``data`` one after another, and their n + 1 offsets."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[index], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from its bytes and offsets."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
