"""Quality rules by repetition coverage.

Words and lines of a block of documents become numbers (a dictionary of their
bytes), hashes of n-grams of several lengths roll over the words' numbers in
numpy and bring equal n-grams side by side, where their words are compared. What
counts is how many characters of a text lie inside n-grams or lines that it
repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm import text as X

#: Percent of a text's word characters that repeated n-grams of each length may cover.
NGRAM_LIMITS = {5: 30, 6: 28, 8: 24, 10: 20}
#: Percent of its lines, and of the characters of lines with a word, that may repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 30, 30
#: Symbols there may be for each hundred words.
SYMBOL_LIMIT = 10
BASE_NGRAM, BASE_WORDS, BASE_LIMIT = 8, 20, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def measure(data: np.ndarray, off: np.ndarray, ngrams: dict[int, int] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """The counts of each document of a block, with base_failed and kept."""
    n = len(off) - 1
    starts, ends, doc = X.words(data, off)
    per_doc = lambda at, weights=None: np.bincount(at, weights, n).astype(np.int64)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    chars = heads[ends] - heads[starts]
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars)}
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=marks[1:])
    out["n_symbols"] = marks[off[1:]] - marks[off[:-1]]

    units = X.codes(data, starts, ends)
    failed = 100 * out["n_symbols"] > SYMBOL_LIMIT * out["n_words"]
    for size in sorted({*ngrams, BASE_NGRAM}):
        last = max(len(units) - size + 1, 0)
        at = np.flatnonzero(doc[:last] == doc[size - 1 : size - 1 + last])
        twice = at[X.repeated_windows(units, doc, at, size)]
        hit = X.covered(twice, size, len(units))
        if size == BASE_NGRAM:
            out["n_repeat_words"] = per_doc(doc[hit])
        if size in ngrams:
            failed |= 100 * per_doc(doc[hit], chars[hit]) > ngrams[size] * out["word_chars"]

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    line_ends = line_ends - (data[line_ends - 1] == 0x0A)
    filled = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = np.searchsorted(off, line_starts, "right") - 1
    keys = X.codes(data, line_starts, line_ends) * np.uint64(n) + line_doc.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order[1:]] == keys[order[:-1]]]
    line_chars = heads[line_ends] - heads[line_starts]
    out["n_dup_lines"] = per_doc(line_doc[again])
    failed |= 100 * out["n_dup_lines"] > LINE_LIMIT * per_doc(line_doc)
    failed |= 100 * per_doc(line_doc[again], line_chars[again]) > LINE_CHAR_LIMIT * per_doc(line_doc, line_chars)
    out["base_failed"] = (out["n_words"] < BASE_WORDS) | (100 * out["n_repeat_words"] > BASE_LIMIT * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~failed
    return out


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngrams: dict[int, int] | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no word and so
    fail the base; repeated rows are measured alike, each for itself; an empty
    table gives no row; other columns are not read. A text of any length is one
    pass over it. No shuffle; a worker holds a few times the larger of
    BLOCK_BYTES and one text.
    """
    ngrams = ngrams or NGRAM_LIMITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in X.blocks(batches):
            got = measure(data, off, ngrams)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(got[c]) for c in [*COLUMNS, "base_failed", "kept"])], names=["doc_id", *COLUMNS, "base_failed", "kept"])

    X.small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, SCHEMA)
