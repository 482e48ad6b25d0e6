"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints meet in the tables of a covering family; in a table's bucket they
agree on the bits that its mask keeps, and pairs of (distinct) fingerprints in
it are verified on the others. A bucket too large for that is covered again over
the bits that its mask leaves out, until it is small or so few bits are left out
that all its fingerprints are within the radius, where a star links them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm import text as X
from halocline.llm.repeats import keyed, with_lists
from halocline.operators.components import star_edges
from halocline.session import cut

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a bucket whose pairs are compared; larger buckets are covered again.
BUCKET = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def masks(radius: int = RADIUS, kept: int = 0) -> list[int]:
    """The 2**(radius+1)-1 bit masks of the covering family over the bits that ``kept`` leaves out; all keep ``kept`` too.

    The i-th such bit has the label 1 + i mod (2**(radius+1)-1), a vector over
    GF(2); mask v keeps the bits whose label has an odd product with v. The
    labels of up to radius differing bits span less than the whole space, so
    that some v is orthogonal to them all, and under that mask the two
    fingerprints agree.
    """
    n = 2 ** (radius + 1) - 1
    free = [i for i in range(64) if not kept >> i & 1]
    return [kept | sum(1 << i for k, i in enumerate(free) if ((1 + k % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def block_fingerprints(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint (uint64) of each document of a block."""
    n = len(off) - 1
    starts, ends, doc = X.words(data, off)
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    joined, at, to = X.spaced(LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    full = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, int)
    short = np.flatnonzero((count > 0) & (count < size))
    begin = np.concatenate([at[full], at[first[short]]])
    end = np.concatenate([to[full + size - 1], to[first[short] + count[short] - 1]])
    owner = np.concatenate([doc[full], short])
    order = np.argsort(owner, kind="stable")
    begin, end, owner = begin[order], end[order], owner[order]
    xx = xxhash.xxh64_intdigest
    total, bits = np.bincount(owner, minlength=n), np.zeros((n, 64), np.int64)
    for low in range(0, len(owner), 1 << 17):
        part = slice(low, low + (1 << 17))
        h = np.fromiter((xx(joined[s:e], SEED) for s, e in zip(begin[part].tolist(), end[part].tolist())), np.uint64, len(owner[part]))
        cuts = np.flatnonzero(np.diff(owner[part], prepend=-1))
        each = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        bits[owner[part][cuts]] += np.add.reduceat(each, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * bits > total[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, t, fp) of every row: t is a hash of the text; A-Z lower-cased, shingles of ``size`` words, XXH64 with seed 42, majority of bits.

    Null, empty and blank texts have 0; fewer words than a shingle are one;
    repeated rows get a row each; null ids stay; an empty table gives no row;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in X.blocks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block_fingerprints(data, off, size).view(np.int64))], names=["doc_id", "t", "fp"])

    X.small_batches(docs.sparkSession)
    return keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, t long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` with the components of "radius or fewer differing bits".

    Every pair within the radius is in some bucket of every covering of it, and
    is verified there, or lies in a star; buckets of up to ``most`` fingerprints
    make no more than most / 2 comparisons for each of them.
    """
    spark, found = distinct.sparkSession, None
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks(radius)))).alias("mask"))
    while True:
        keyed_ = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        size = keyed_.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1")
        met = cut(keyed_.join(size, ["mask", "key"]))
        open_ = 64 - F.bit_count("mask")
        star = met.where((open_ <= radius) & (F.col("fp") != F.col("low"))).select(F.col("fp").alias("u"), F.col("low").alias("v"))
        few = met.where((open_ > radius) & (F.col("n") <= most)).select("mask", "key", "fp")
        other = few.withColumnRenamed("fp", "other")
        near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
        pairs = few.join(other, ["mask", "key"]).where(near).select(F.col("fp").alias("u"), F.col("other").alias("v"))
        edges = star.union(pairs)
        found = edges if found is None else found.union(edges)
        large = met.where((open_ > radius) & (F.col("n") > most)).select("fp", "mask")
        used = [r["mask"] for r in large.select("mask").distinct().collect()]  # of a family of masks, whatever the data
        if not used:
            return found.distinct()
        finer = spark.createDataFrame([(m, _signed(x)) for m in used for x in masks(radius, m % 2**64)], "mask long, finer long")
        rows = large.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, t, root, fingerprint (16 hex digits), component_id of every row.

    Null, empty and blank texts have fingerprint 0 and link like any other;
    repeated rows share a component and each gets a row; component_id is the
    smallest non-null doc_id reachable (null if there is none); an empty table
    gives no row; other columns are not read; a text of any length is hashed
    whole, a part of its shingles at a time. Equal fingerprints are one vertex,
    so copies add no links. t (a hash of the text) tells apart rows with the
    same id, root (the least fingerprint) the components.
    """
    prints = cut(fingerprints(docs, doc_id, text, size))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"))
    star = star_edges(links(distinct.select("fp"), radius))
    rooted = distinct.join(star, distinct["fp"] == star["hi"], "left").select("fp", "low_id", F.coalesce("lo", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = rooted.join(component, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "t", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the smallest id's (then the least text hash's; null ids come last).

    A wider radius costs 2**(radius+1)-1 tables, and as many again for each time
    that a large bucket has to be covered anew, so it is kept at two bits here.

    Of rows with the same id and text one stays; all texts without a word are
    one component; all columns stay as they are; empty in, empty out.
    """
    near = near_duplicates(docs, doc_id, text, size, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("t").alias("t")))
    stay = near.groupBy("root").agg(first.alias("one")).select("one.doc_id", "one.t")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return with_lists(rows, stay, "left_semi").dropDuplicates(["doc_id", "t"]).select("row.*")
