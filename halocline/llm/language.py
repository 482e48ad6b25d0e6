"""Language identification by compression.

Each language's model is a zstandard raw-content dictionary cut from sampled
training texts, in lower case. A text is compressed with every dictionary; the
smallest result names the language, and a narrow margin to the runner-up rejects
the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm import text as X
from halocline.llm.joins import sized
from halocline.session import cut

#: The model's bounds: at most so many training rows a language, and so many bytes of each and of a dictionary.
SAMPLE_ROWS, SLICE_CHARS, DICTIONARY_BYTES = 96, 1200, 96 << 10
#: Texts are compressed in pieces of so many bytes, so that the dictionary matters for all of a long one.
PIECE = 4096
#: zstandard's level for every text.
LEVEL = 9
#: A text is rejected if the runner-up is larger by less than this share.
MARGIN = 0.004
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, margin double, accepted boolean"


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each non-null language, from SAMPLE_ROWS rows of it at most.

    A language's rows fall into SAMPLE_ROWS slots by a hash; the smallest hash in
    each slot is taken (an aggregate with map-side partial results, so a language
    with most rows is no hot spot), and a slice at a hashed place of its text.
    Only these bounded slices reach the driver. Rows without a language or text
    teach nothing; repeated rows fall into one slot and count once; an empty
    table, or one without labels, gives an empty model; other columns are not
    read. Of a long text only the slice is learned.
    """
    row = F.xxhash64(F.col(doc_id), F.lit("sample"))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN)).select(
        F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(doc_id), F.lit("slot")), F.lit(SAMPLE_ROWS)).alias("slot"), row.alias("h"), F.col(text).alias("text")
    )
    chosen = sized(cut(rows.groupBy("lang", "slot").agg(F.min("h").alias("h"))))
    span = F.greatest(F.length("text") - SLICE_CHARS, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.col("h"), span) + 1).cast("int"), F.lit(SLICE_CHARS))
    slices = rows.join(chosen, ["lang", "slot", "h"]).select("lang", "slot", piece.alias("text")).groupBy("lang", "slot").agg(F.max("text").alias("text"))
    got: dict[str, list[bytes]] = {}
    for r in slices.orderBy("lang", "slot").toLocalIterator():
        got.setdefault(r["lang"], []).append(r["text"].lower().encode())
    return {k: b"\n".join(v)[:DICTIONARY_BYTES] for k, v in got.items()}


class Classifier:
    """Sizes of a text under each dictionary, and what follows from them."""

    def __init__(self, model: dict[str, bytes]):
        self.names = sorted(model)
        self.coders = [self._coder(model[name]) for name in self.names]

    @staticmethod
    def _coder(raw: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, raw: bytes) -> list[int]:
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, accepted); the score is the best one's share of 2**-(bytes more than the best)."""
        if text is None or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, False
        ranked = sorted(zip(self.sizes(text.lower().encode()), self.names))
        best, second = ranked[0][0], ranked[1][0] if len(ranked) > 1 else 2 * ranked[0][0]
        margin = (second - best) / second
        return ranked[0][1], 1 / sum(math.pow(2, best - size) if size - best < 60 else 0.0 for size, _ in ranked), margin, margin >= MARGIN


def classify(docs: DataFrame, model: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted of every row.

    Null texts, and texts without a letter (empty ones too), are ``und`` with
    score 0 and not accepted; ties go to the first name; repeated rows are
    judged alike; an empty model makes every text ``und``; an empty table gives
    no row; no other column is read; a text is compressed whole, in pieces. No shuffle; the model (bounded above) goes out with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(model)
        for batch in batches:
            rows = [judge(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "lang_pred", "score", "margin", "accepted"])

    X.small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, SCHEMA)


def accepts(text: Column, model: dict[str, bytes]) -> Column:
    """Whether a text's language is plain enough: the ``accepted`` of :func:`classify`, as a column for filters."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Classifier(model)
        for texts in batches:
            yield pd.Series([judge(t)[3] for t in texts], dtype=bool)

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
