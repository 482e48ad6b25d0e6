"""Substring deduplication by words: seed and extend.

Documents are joined on winnowed anchors (see repeats.py). The distinct segments
around an anchor are extended from it to the left and to the right, a word at a
time: those that agree so far stay one class. A segment matches another over
the left and right lengths that they share, and what is kept are the runs of
windows that some match covers whole, which are maximal repeats over the length
threshold. All members of a group extend at once, so no pair is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm import repeats as R
from halocline.llm import text as X

#: Words of a repeated passage, and of the grams that anchors are chosen from.
WINDOW, GRAM = 35, 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


def _cut(ids, data, off, starts, ends, place, gone) -> pa.RecordBatch:
    raw, kept = data.tobytes(), []
    for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
        keep = np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())]))
    total = np.append(0, np.cumsum(gone))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(place).astype(np.int64)), pa.array((total[place[1:]] - total[place[:-1]]).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs (class so far, next word)."""
    return np.unique(before * np.uint64(int(word.max()) + 1) + word, return_inverse=True)[1].astype(np.uint64)


def extended(window: int) -> R.Search:
    """The search of repeats.shard_rows() by extension: a window with l words before the anchor repeats if others are in its class after l words to the left and after the rest to the right."""

    def search(data, off, group, low, high, x, y, c) -> np.ndarray:
        starts, ends, doc = X.words(data, off)
        place = np.searchsorted(doc, np.arange(len(off)))
        words = np.append(X.codes(data, starts, ends) + np.uint64(1), np.uint64(0))  # a place outside the segment reads as 0
        inside = lambda i: words[np.where((i >= place[:-1]) & (i < place[1:]), i, len(words) - 1)]
        count = high - low + 1
        base = np.cumsum(count) - count
        hit = np.zeros(int(count.sum()), bool)
        for width in np.unique(y - x):
            own = np.flatnonzero(y - x == width)
            extra = window - int(width)
            left, right = [group.astype(np.uint64)], [group.astype(np.uint64)]
            for k in range(extra):
                left.append(_classes(left[-1], inside(place[:-1] + x - 1 - k)))
                right.append(_classes(right[-1], inside(place[:-1] + y + k)))
            for k in range(extra + 1):
                at = own[(x[own] - k >= low[own]) & (x[own] - k <= high[own])]
                if len(at):
                    _, both = np.unique(left[k][at] * np.uint64(len(group)) + right[extra - k][at], return_inverse=True)
                    hit[base[at] + x[at] - k - low[at]] = np.bincount(both, c[at])[both] > 1
        return hit

    return search


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", most: int = R.MOST_KINDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row.

    Words ``[^\\x20\\x09-\\x0D]+`` covered by ``window`` words that also start
    elsewhere (same text included) go; the others are joined by one space. Null,
    empty and blank texts have no word; shorter texts lose none; repeated rows
    repeat each other and lose all; null ids stay; an empty table gives no row;
    other columns are not read. A text of any length is one row of a batch; its
    segments are what meets others. A group of more than ``most`` distinct
    segments is split by the words next to its gram.
    """
    X.small_batches(docs.sparkSession)
    unit, rows = R.Unit(True, window, gram), R.keyed(docs, doc_id, text)
    return R.remove(rows, R.repeats(rows, unit, extended(window), most), unit, _cut, SCHEMA)
