"""Repeated windows of units (words or bytes) over all documents: seeds and their maximal runs.

Winnowing gives each window one anchor, the least gram in it, chosen by the
window's content alone; equal windows have equal anchors. A *seed* is an anchor
with the run of windows it stands for and the segment of units they span. From
these narrow rows:

- a gram found once: none of its windows repeats;
- the seeds of other grams become *kinds*: distinct segments (by 128 bits of
  their bytes), each with its multiplicity, so copies are looked at once;
- the segments of a gram's kinds meet in one shard, where the operator's own
  search decides which of their windows repeat, counting multiplicities;
- what it found is joined back to all seeds of the kind.

A gram with more kinds than a shard should get is split by the units next to its
anchor: of the units that a window has besides the anchor, at least half are on
one side of it, so windows that are equal meet under the anchor grown to that
side. Anchors grow until the groups are small, or fill the window.

No step makes pairs. Grouped counts have map-side partial results, and joins on
a gram or a kind are ordinary equi-joins, so that a very common one can be split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm import text as X
from halocline.session import cut, saved

#: Buckets of row keys; which of them are met is broadcast, so that other texts needn't be shuffled.
KEY_BUCKETS = 1 << 18
#: Text bytes that one numpy pass takes: its arrays should stay in the processor's cache.
PASS_BYTES = 1 << 20
BYTE_UNIT = X.mix(X.BYTE_VALUE.copy())
SEED_SCHEMA = "gram long, a long, b long, doc_id long, t long, first int, n int, at int"
KIND = ["gram", "a", "b"]
#: Bytes of a shard, and kinds that one group of a shard may have.
SHARD_BYTES, MOST_KINDS = 1 << 20, 4096
PIECE = "ka long, kb long, gram long, a long, b long, c long, low int, high int, x int, y int, segment binary"
RUN = "a long, b long, off int, m int"


@dataclass(frozen=True)
class Unit:
    """What windows are made of, how many units they have, and how many a gram has."""

    words: bool
    window: int
    gram: int

    def split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit hashes, offsets of the documents in units)."""
        if not self.words:
            return BYTE_UNIT[data], off
        starts, ends, doc = X.words(data, off)
        return X.segment_hashes(data, starts, ends), np.searchsorted(doc, np.arange(len(off)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: running minima forth and back inside blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    whole = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    whole[: len(values)] = values
    grid = whole.reshape(-1, width)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def gram_sums(units: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each ``gram`` consecutive units, from running sums."""
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * X.powers(X.BASE, len(units)), out=sums[1:])
    m = max(len(units) - gram + 1, 0)
    return X.mix((sums[gram : gram + m] - sums[:m]) * X.powers(X.UNBASE, len(units) + 1)[:m])


def seeds(units: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, place of the anchor in the segment, gram hash) of each seed of a block."""
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(off) - window + 1, 0)
    if not count.sum():
        return none, none, none, none, none.view(np.uint64)
    grams = gram_sums(units, gram)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # ties: the leftmost
    anchor = (sliding_min(keys, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][doc]  # the windows inside documents
    place = anchor[at]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    n = np.diff(np.append(new, len(at)))
    low, p = at[new], place[new]
    return doc[new], low - off[doc[new]], n, p - low, grams[p]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (a hash of the text: with doc_id it names a row and its repetitions), text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))


def gram_rows(rows: DataFrame, unit: Unit) -> DataFrame:
    """(gram) of every seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in X.blocks(batches, most=PASS_BYTES):
            gram = seeds(*unit.split(data, off), unit.window, unit.gram)[4]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=["gram"])

    return rows.mapInArrow(run, "gram long")


def kind_of(segments: Iterable[bytes]) -> np.ndarray:
    """128 bits of each segment's bytes, in two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, segments)), "<i8").reshape(-1, 2)


def seed_rows(rows: DataFrame, unit: Unit) -> DataFrame:
    """Every seed: its gram, its kind (a, b: 128 bits of the segment's bytes), its row, first window, number of windows and the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in X.blocks(batches, most=PASS_BYTES):
            if unit.words:
                starts, ends, owner = X.words(data, off)
                place = np.searchsorted(owner, np.arange(len(off)))
                units = X.segment_hashes(data, starts, ends)
                raw, begin, end = X.spaced(data, starts, ends)
            else:
                units, place, raw = BYTE_UNIT[data], off, data.tobytes()
            doc, first, n, at, gram = seeds(units, place, unit.window, unit.gram)
            low = place[doc] + first
            high = low + n - 1 + unit.window
            if unit.words and len(low):
                low, high = begin[low], end[high - 1]
            kind = kind_of(raw[i:j] for i, j in zip(low.tolist(), high.tolist()))
            to = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(kind[:, 0]), pa.array(kind[:, 1]), batch.column(0).take(to), batch.column(1).take(to), *(pa.array(x.astype(np.int32)) for x in (first, n, at))],
                names=["gram", "a", "b", "doc_id", "t", "first", "n", "at"],
            )

    return rows.mapInArrow(run, SEED_SCHEMA)


def met(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among ``keys`` by doc_id and t, rows that surely aren't), told apart without a shuffle of texts.

    What is broadcast is which of KEY_BUCKETS buckets are used: KEY_BUCKETS rows at most.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "t"), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")
    used = F.broadcast(keys.select(bucket).distinct())
    marked = rows.withColumn("bucket", bucket)
    return marked.join(used, "bucket", "left_semi").drop("bucket"), marked.join(used, "bucket", "left_anti").drop("bucket")


def with_lists(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``lists`` on doc_id and t."""
    named = lists.withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), how).drop("_id", "_t")  # drop() passes over names that a semi-join hasn't


def piece_rows(rows: DataFrame, kinds: DataFrame, unit: Unit) -> DataFrame:
    """A piece for each kind (also c, and the doc_id, t, first, n, at of one seed): the segment's bytes, its windows low to high, and its anchor x to y in units."""
    lists = kinds.groupBy("doc_id", "t").agg(F.collect_list(F.struct("gram", "c", "first", "n", "at")).alias("s"))
    texts = with_lists(met(rows, kinds)[0].dropDuplicates(["doc_id", "t"]), lists, "inner").select("text", *(f"s.{x}" for x in ("gram", "c", "first", "n", "at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in X.blocks(batches, most=PASS_BYTES):
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            gram, c, first, n, at = (batch.column(i).flatten() for i in range(1, 6))
            n_, at_ = n.to_numpy(), at.to_numpy()
            if unit.words:
                starts, ends, doc = X.words(data, off)
                place = np.searchsorted(doc, np.arange(len(off)))
                raw, begin, end = X.spaced(data, starts, ends)
            else:
                place, raw = off, data.tobytes()
            low = place[owner] + first.to_numpy()
            high = low + n_ - 1 + unit.window
            if unit.words:
                low, high = begin[low], end[high - 1]
            parts = [raw[i:j] for i, j in zip(low.tolist(), high.tolist())]
            a, b = (pa.array(x) for x in kind_of(parts).T)
            zero = pa.array(np.zeros(len(n_), np.int64))
            yield pa.RecordBatch.from_arrays(
                [gram, zero, gram, a, b, c, zero.cast(pa.int32()), pa.array((n_ - 1).astype(np.int32)), at, pa.array((at_ + unit.gram).astype(np.int32)), pa.array(parts, pa.binary())],
                names=["ka", "kb", *KIND, "c", "low", "high", "x", "y", "segment"],
            )

    return texts.mapInArrow(run, PIECE)


def grown(pieces: DataFrame, unit: Unit) -> DataFrame:
    """The pieces under their anchors grown by half of what a window has besides, to the right and to the left; each with the windows that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                units, join = (r["segment"].split(b" "), b" ".join) if unit.words else (r["segment"], bytes)
                extra = unit.window - (r["y"] - r["x"])
                half = (extra + 1) // 2
                right = (max(r["low"], r["y"] + half - unit.window), r["high"], r["x"], r["y"] + half)
                left = (r["low"], min(r["high"], r["y"] + half - unit.window - 1), r["x"] - (extra - half + 1), r["y"])
                for low, high, x, y in (right, left):
                    if low <= high:
                        key = kind_of([join(units[x:y])])[0]
                        out.append(r | {"ka": int(key[0]), "kb": int(key[1]), "low": low, "high": high, "x": x, "y": y})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return pieces.mapInArrow(run, PIECE)


def split_hot(pieces: DataFrame, unit: Unit, most: int = MOST_KINDS) -> DataFrame:
    """Pieces of too large groups (ka, kb), in groups of ``most`` at most or whose anchors fill the window."""
    done, rest = [], pieces
    while True:
        rest = saved(grown(rest, unit))
        hot = cut(rest.where(F.col("y") - F.col("x") < unit.window).groupBy("ka", "kb").agg(F.count("*").alias("n")).where(F.col("n") > most).select("ka", "kb"))
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, done, rest)
        done.append(rest.join(hot, ["ka", "kb"], "left_anti"))
        rest = rest.join(hot, ["ka", "kb"]).select(*pieces.columns)


Search = Callable[..., np.ndarray]


def shard_rows(pieces: DataFrame, unit: Unit, search: Search, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(a, b, off, m): runs of repeated windows of each kind, by ``search`` over shards of whole groups.

    search(data, off, group, low, high, x, y, c) gets the segments' bytes and
    says of each piece's windows low to high, one piece after the other, whether
    they start twice or more, counting a piece c times.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            at = 0
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            lengths = X.buffers(X.as_bytes(batch.column(10)))[1]
            for to in [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]:
                if size >= shard_bytes and tuple(keys[at]) != last:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
                held.append(batch.slice(at, to - at))
                size, last, at = size + int(lengths[to] - lengths[at]), tuple(keys[to - 1]), to
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(b for b in batches if b.num_rows):
            keys = [shard.column(i).to_numpy() for i in (0, 1)]
            c, low, high, x, y = (shard.column(i).to_numpy().astype(np.int64) for i in range(5, 10))
            group = np.cumsum(np.append(False, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])))
            data, off = X.buffers(X.as_bytes(shard.column(10)))
            hit = search(data, off, group, low, high, x, y, c)
            count = high - low + 1
            base = np.cumsum(count) - count
            new = hit.copy()
            new[1:] &= ~hit[:-1]
            new[base] = hit[base]
            start = np.flatnonzero(new)
            piece = np.searchsorted(base, start, "right") - 1
            total = np.append(0, np.cumsum(hit))
            m = total[np.append(start[1:], len(hit))] - total[start] if len(start) else start
            to = pa.array(piece)
            off_ = (start - base[piece] + low[piece]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(shard.column(i).take(to) for i in (3, 4)), pa.array(off_), pa.array(m.astype(np.int32))], names=["a", "b", "off", "m"])
        X.release()

    return pieces.repartition("ka", "kb").sortWithinPartitions("ka", "kb").mapInArrow(run, RUN)


def repeats(rows: DataFrame, unit: Unit, search: Search, most: int = MOST_KINDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, t, first, n): runs of windows that also start elsewhere."""
    # written out first: a join with the aggregate itself would keep a common gram's seeds in one task
    common = cut(gram_rows(rows, unit).groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"))
    # a merge join leaves the seeds by gram, as the kinds want them
    shared = cut(seed_rows(rows, unit).join(common.hint("merge"), "gram"))
    one = F.min(F.struct("doc_id", "t", "first", "n", "at"))
    kinds = saved(shared.groupBy(*KIND).agg(F.count("*").alias("c"), one.alias("one")).select(*KIND, "c", "one.*"))
    hot = cut(kinds.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most).select("gram"))
    if hot.isEmpty():
        pieces = piece_rows(rows, kinds, unit)
    else:
        pieces = piece_rows(rows, kinds.join(hot, "gram", "left_anti"), unit).unionByName(split_hot(piece_rows(rows, kinds.join(hot, "gram"), unit), unit, most))
    runs = saved(shard_rows(pieces, unit, search, shard_bytes))
    # by merge at every size, as above
    return shared.drop("gram").join(runs.hint("merge"), ["a", "b"]).select("doc_id", "t", (F.col("first") + F.col("off")).alias("first"), F.col("m").alias("n"))


def remove(rows: DataFrame, found: DataFrame, unit: Unit, digest, schema: str) -> DataFrame:
    """``digest(ids, data, off, unit offsets, removed mask)`` over all rows, where a unit is removed if a window of ``found`` (doc_id, t, first, n) covers it."""
    lists = saved(found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "n")).alias("s")).select("doc_id", "t", "s.first", "s.n"))
    maybe, rest = met(rows, lists)
    none = F.array().cast("array<int>")
    plan = with_lists(maybe, lists, "left").select("doc_id", "text", F.coalesce("first", none).alias("first"), F.coalesce("n", none).alias("n")).union(rest.select("doc_id", "text", none, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in X.blocks(batches, most=PASS_BYTES):
            if unit.words:
                starts, ends, doc = X.words(data, off)
                place = np.searchsorted(doc, np.arange(len(off)))
            else:
                starts, ends, place = None, None, off
            lists_ = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists_.offsets.to_numpy()))
            low = place[owner] + lists_.flatten().to_numpy()
            step = np.zeros(int(place[-1]) + 1, np.int64)
            np.add.at(step, low, 1)
            np.add.at(step, low + batch.column(3).flatten().to_numpy() - 1 + unit.window, -1)
            yield digest(batch.column(0), data, off, starts, ends, place, np.cumsum(step[:-1]) > 0)

    return plan.mapInArrow(run, schema)
