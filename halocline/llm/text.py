"""Byte-level text primitives over Arrow batches: words, segment hashes, bounded blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from halocline.session import ship

#: Bytes of text that one numpy pass holds at most, unless a single document is larger.
BLOCK_BYTES = 4 << 20

#: Bytes of an Arrow batch, unless a single row is larger.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Bytes whose hash sums are held at once: small, as each takes three 8-byte values.
HASH_BYTES = 256 << 10

#: White space of all word operators: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
#: A random odd 64-bit value for each byte value, and the odd base of the polynomial hash.
BYTE_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; tables are kept and grown by doubling."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16, 2 * len(got) if got is not None else 0), base, np.uint64)
        got[0] = 1
        got = _powers[int(base)] = np.multiply.accumulate(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large_binary; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array; the offsets start at 0."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and the next stage's share the executor with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most ``most`` bytes of text (a larger text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
        _, off = buffers(texts)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            data, part = buffers(texts.slice(at, to - at))
            yield batch.slice(at, to - at), data, part
            at = to
    batch = texts = data = part = None
    release()


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the maximal runs without white space; none spans two documents."""
    inside = ~IS_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def contents(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the segments (sorted, not overlapping) as large_binary."""
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    np.subtract.at(step, ends, 1)
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    offsets = np.append(0, np.cumsum(ends - starts))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each segment, equal for equal bytes and for no others; it means something in this call only."""
    return contents(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the words with one space between those of a document, so that a slice from one word's start to another's end is canonical."""
    keep = ~IS_SPACE[data]
    trailing = ends[ends < len(data)]
    keep[trailing[IS_SPACE[data[trailing]]]] = True
    plain = np.where(IS_SPACE[data], np.uint8(0x20), data)
    at = (np.cumsum(keep) - 1)[starts]
    return plain[keep].tobytes(), at, at + (ends - starts)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = HASH_BYTES) -> np.ndarray:
    """A 64-bit hash of each segment's bytes. Segments are sorted and don't overlap; memory follows ``most`` or the longest segment.

    A polynomial mod 2**64 collides on constructible bytes, so this only picks
    anchors and buckets; whatever decides a result compares the bytes.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data[low:high]] * powers(BASE, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * powers(UNBASE, high - low + 1)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive units (empty if there are fewer)."""
    if len(units) < n:
        return units[:0]
    sums = np.zeros(len(units) - n + 1, np.uint64)
    for k in range(n):
        sums *= BASE
        sums += units[k : k + len(sums)]
    return sums


def repeated_windows(units: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` units, from the places ``at``, are found twice or more in the document (``owner`` of the first unit) they are in.

    Equal hashes only bring windows side by side; their units are compared.
    """
    hashes = mix(window_hashes(mix(units), n)[at] + mix((owner[at].astype(np.uint64) + np.uint64(1)) * BASE))
    order = np.argsort(hashes, kind="stable")
    near = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    a, b = at[order[near]], at[order[near + 1]]
    same = owner[a] == owner[b]
    for k in range(n):
        same &= units[a + k] == units[b + k]
    out = np.zeros(len(at), bool)
    if not same.all():  # a collision: count the windows themselves
        _, group, count = np.unique(np.column_stack([owner[at].astype(np.uint64), *(units[at + k] for k in range(n))]), axis=0, return_inverse=True, return_counts=True)
        return count[group.ravel()] > 1
    out[order[near]] = out[order[near + 1]] = True
    return out


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` units a window of ``width`` units covers that starts at one of the (distinct) places ``at``."""
    step = np.zeros(n + 1, np.int32)
    step[at] += 1
    step[at + width] -= 1
    return np.cumsum(step[:-1]) > 0


def small_batches(spark) -> None:
    """Bound the bytes of one Arrow batch of long texts in a Python worker (a setting that is only ever lowered); give the workers this package."""
    ship(spark)
    now = int(spark.conf.get(BATCH_SETTING).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
