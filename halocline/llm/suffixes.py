"""Exact byte deduplication by suffix arrays built with induced sorting.

Documents' windows are narrowed down to seeds with a common gram (see
repeats.py); each distinct segment around one goes, with its multiplicity, into
a shard of whole grams. The shard's suffix array is built by induced sorting,
and windows repeat where common prefixes are long enough and the suffixes
together stand for two places or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm import repeats as R
from halocline.llm import text as X

WINDOW, GRAM = 200, 50
#: Up to this alphabet, induction runs over whole buckets; beyond it, over single suffixes.
BUCKETWISE = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S); the last position is the sentinel's and S."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    out = np.ones(n, bool)
    out[: n - 1] = step[np.minimum(nearest, n - 2)] > 0 if n > 1 else out[: n - 1]
    return out


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The number of equal values before each one."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(groups) else order
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
    return out


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix order that the (sorted) leftmost-smaller suffixes induce, a bucket at a time.

    What a bucket induces in itself are the places before its suffixes in runs
    of its own letter: all those one step back, then two, and so on, which is
    known at once. The whole bucket then induces into the others in one step.
    """
    n = len(s)
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    order = np.full(n, -1, np.int64)
    chars = s[lms]
    per = np.bincount(chars, minlength=k)
    order[ends[chars] - per[chars] + _ranks(chars)] = lms
    place = np.arange(n)
    back = place - np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), place, 0))  # equal letters just before

    heads = starts.copy()
    for c in np.flatnonzero(counts):
        own = _before_in_runs(order[starts[c] : heads[c]], back)
        order[heads[c] : heads[c] + len(own)] = own
        heads[c] += len(own)
        _put(order, heads, s, order[starts[c] : heads[c]], c, 1)
        if per[c]:
            _put(order, heads, s, order[ends[c] - per[c] : ends[c]], c, 1)
    # the smaller ones are placed anew, from the right
    larges, tails = counts - np.bincount(s[small], minlength=k), ends.copy()
    for c in np.flatnonzero(counts)[::-1]:
        own = _before_in_runs(order[tails[c] : ends[c]][::-1], back)
        order[tails[c] - len(own) : tails[c]] = own[::-1]
        tails[c] -= len(own)
        _put(order, tails, s, order[tails[c] : ends[c]][::-1], c, -1)
        if larges[c]:
            _put(order, tails, s, order[starts[c] : starts[c] + larges[c]][::-1], c, -1)
    order[0] = n - 1
    return order


def _before_in_runs(wave: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The places one step before those of a wave in their runs, then those two steps before, and so on."""
    depth = back[wave]
    total = int(depth.sum())
    if not total:
        return wave[:0]
    owner = np.repeat(np.arange(len(wave)), depth)
    step = np.arange(total) - np.repeat(np.cumsum(depth) - depth, depth) + 1
    by = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
    return wave[owner[by]] - step[by]


def _put(order: np.ndarray, ends: np.ndarray, s: np.ndarray, wave: np.ndarray, c: int, way: int) -> None:
    """Put the predecessors of a wave of bucket ``c`` that lie in later (way 1) or earlier (-1) buckets at those buckets' ends (heads or tails), in order."""
    before = wave[wave > 0] - 1
    to = s[before]
    wanted = to > c if way > 0 else to < c
    before, to = before[wanted], to[wanted]
    if not len(before):
        return
    by = np.argsort(to, kind="stable")
    before, to = before[by], to[by]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    size = np.diff(np.append(first, len(to)))
    rank = np.arange(len(to)) - np.repeat(first, size)
    order[ends[to] + rank if way > 0 else ends[to] - 1 - rank] = before
    ends[to[first]] += way * size


def _induce_single(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same order, a suffix at a time: for alphabets whose buckets are small."""
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    order = np.full(len(s), -1, np.int64)
    chars = s[lms]
    per = np.bincount(chars, minlength=k)
    order[ends[chars] - per[chars] + _ranks(chars)] = lms
    # the letter before each place, if the place before is of the wanted type; -1 otherwise, and where nothing is filled in yet
    before = np.append(np.append(-1, s[:-1].astype(np.int64)), -1)
    is_small = np.append(np.append(False, small[:-1]), False)
    line, large_before, small_before = order.tolist(), np.where(is_small, -1, before).tolist(), np.where(is_small, before, -1).tolist()
    heads, tails = (ends - counts).tolist(), (ends - 1).tolist()
    for j in line:
        c = large_before[j]
        if c >= 0:
            h = heads[c]
            line[h] = j - 1
            heads[c] = h + 1
    for i in range(len(line) - 1, -1, -1):
        j = line[i]
        c = small_before[j]
        if c >= 0:
            t = tails[c]
            line[t] = j - 1
            tails[c] = t - 1
    line[0] = len(s) - 1
    return np.array(line, np.int64)


def _names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The rank of each leftmost-smaller substring (to the next one's first letter) among the distinct ones.

    As many letters (each with its type, larger first) as fit are packed into a
    number; substrings with equal numbers that go on are told apart by the next
    letters.
    """
    letter = 2 * s.astype(np.uint64) + small + np.uint64(1)  # 0: past the substring's end
    width, n = (2 * k).bit_length(), len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    rank, active, step = np.zeros(n, np.int64), np.arange(n), 0
    while len(active):
        fits = max(1, (63 if step == 0 else 63 - n.bit_length()) // width)
        key = np.zeros(len(active), np.uint64) if step == 0 else rank[active].astype(np.uint64)
        for i in range(step, step + fits):
            inside = i < length[active]
            key = (key << np.uint64(width)) | np.where(inside, letter[np.where(inside, lms[active] + i, 0)], np.uint64(0))
        step += fits
        order = np.argsort(key, kind="stable")
        key, old, at = key[order], rank[active][order], np.arange(len(active))
        new = np.append(True, key[1:] != key[:-1])
        first, group = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        rank[active[order]] = old + first - group
        alone = new & np.append(new[1:], True)
        rest = active[order[~alone]]
        active = rest[length[rest] > step]
    return np.unique(rank, return_inverse=True)[1]


def _order_named(lms: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The leftmost-smaller suffixes in order, by recursion on the string of their substrings' names.

    A name found once settles every comparison that reaches it. So the names
    after it are left out up to the next common one; their own suffixes are in
    the order of the names already.
    """
    once = np.bincount(names)[names] == 1
    kept = np.flatnonzero(~(once & np.append(False, once[:-1])) | (np.arange(len(names)) == len(names) - 1))
    _, short = np.unique(names[kept], return_inverse=True)
    ranked = kept[_sort(short.astype(np.int64), int(short.max()) + 1)]
    out = np.ones(len(names), bool)
    out[kept] = False
    every = np.concatenate([ranked, np.flatnonzero(out)])
    return lms[every[np.argsort(names[every], kind="stable")]]


def _sort(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of ``s``, whose last value 0 is its only one."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.uint16) if k <= 1 << 16 else s  # numpy sorts two-byte values in linear time
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _names(s, small, lms, k)
    lms = _order_named(lms, names) if names.max() + 1 < len(lms) else lms[np.argsort(names)]
    induce = _induce_buckets if k <= BUCKETWISE else _induce_single
    return induce(s, small, lms, k)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``data`` (uint8) in ascending order."""
    return _sort(np.append(data.astype(np.int64) + 1, 0), 257)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The length each suffix (by rank) shares with the one before it.

    Permuted: by place, a suffix whose predecessor in the order continues the
    last one's has one less than that; only the others are compared.
    """
    n = len(order)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    place = np.arange(n)
    reducible = (place > 0) & (phi > 0)
    reducible[reducible] = (data[place[reducible] - 1] == data[phi[reducible] - 1]) & (phi[place[reducible] - 1] == phi[reducible] - 1)
    shared = np.zeros(n, np.int64)
    active = np.flatnonzero(~reducible & (phi >= 0))
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(wide, (n, 8), (1, 1)).copy().view("<u8").ravel()  # the eight bytes from each place on
    step = 0
    while len(active):  # whole eights first
        a, b = active + step, phi[active] + step
        fits = np.maximum(a, b) + 8 <= n
        same = fits & (eight[np.where(fits, a, 0)] == eight[np.where(fits, b, 0)])
        shared[active] = step
        active = active[same]
        step += 8
    active = np.flatnonzero(~reducible & (phi >= 0))
    for _ in range(8):
        a, b = active + shared[active], phi[active] + shared[active]
        active = active[np.maximum(a, b) < n]
        active = active[data[active + shared[active]] == data[phi[active] + shared[active]]]
        shared[active] += 1
    nearest = np.maximum.accumulate(np.where(reducible, 0, place))
    return (shared[nearest] + nearest - place)[order]


def shard_repeats(window: int) -> R.Search:
    """The search of repeats.shard_rows() by a shard's suffix array: suffixes in a row that share ``window`` bytes are one window's places."""

    def search(data, off, group, low, high, x, y, c) -> np.ndarray:
        order = suffix_array(data)
        shared = np.cumsum(common_prefixes(data, order) < window)
        rank = np.empty(len(data), np.int64)
        rank[order] = shared
        count = high - low + 1
        piece = np.repeat(np.arange(len(low)), count)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count - off[:-1] - low, count)
        return np.bincount(rank[at], c[piece])[rank[at]] > 1

    return search


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(ids, data, off, starts, ends, place, gone) -> pa.RecordBatch:
    keep = np.append(0, np.cumsum(~gone))
    kept = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(keep[off].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    head[first] = gone[first]
    runs = np.append(0, np.cumsum(head))
    n = np.diff(off)
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(n - np.diff(keep[off])), pa.array(np.diff(runs[off])), kept.cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", most: int = R.MOST_KINDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row.

    Bytes covered by ``window`` bytes that also start elsewhere (same text
    included; matches never cross texts) go; ``kept`` are the others. Null texts
    are empty; shorter texts lose nothing; repeated rows repeat each other and
    lose all; null ids stay; an empty table gives no row; other columns are not
    read. A text of any length is one row of a batch; its segments are what
    meets others. A group of more than ``most`` distinct segments is split by
    the bytes next to its gram.
    """
    X.small_batches(docs.sparkSession)
    unit, rows = R.Unit(False, window, gram), R.keyed(docs, doc_id, text)
    return R.remove(rows, R.repeats(rows, unit, shard_repeats(window), most), unit, _cut, SCHEMA)
