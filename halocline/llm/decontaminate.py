"""Benchmark decontamination by SimHash of item-sized windows, verified exactly. DataFrame functions only.

A window passes if its weighted Jaccard similarity to an item (five-word
shingles, weights are their counts) is 0.8 or more. With as many shingles L in
the window as in the item that asks for ceil(8 L / 9) common ones. A text of
fewer shingles M than the item is one window, which needs ceil(4 (L + M) / 9). So

1. only texts with so many places of an item's shingles can have a window, and
   of a text's windows only those that begin with such a place matter (a window
   moved on to the next place, or back from the text's end, keeps all it had);
2. each such window and each item has a SimHash, the signs of 64 weighted sums.
   What a passing window has not in common with the item moves a sum by
   2 (L - ceil(8 L / 9)) at most, so an item's bits whose sums are larger are the
   same in every window that passes. These bits, in BLOCKS blocks, are the index
   of an item; a window goes on if it agrees in all of an item's blocks;
3. the rest are compared exactly, on the counts of their shingles.

The radius is thus each item's own (64 less its fixed bits), and no window that
passes can be beyond it. No radius that is the same for all items has this: a
shingle repeated in the rest of a window pulls a SimHash away without limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.joins import sized
from halocline.session import cut

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and blocks that they are compared in.
BITS, BLOCKS = 64, 4
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: Column) -> Column:
    """Lower-cased words; null and blank texts have none."""
    bare = F.btrim(F.lower(text), F.lit(SPACE_CHARS))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def _places(source: DataFrame, keys: list[str], size: int, start: Column, n: Column) -> DataFrame:
    """keys, pos, h: the hash of ``size`` words from each of the ``n`` places from ``start`` (1-based)."""
    at = F.sequence(start, start + n - 1)
    return source.select(*keys, F.explode(F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("words", i, size)).alias("h")))).alias("_p")).select(*keys, "_p.pos", "_p.h")


def _bit(b: int) -> int:
    return (1 << b) - (1 << 64 if b == 63 else 0)


def bit_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sums: for each bit how many of the hashes ``h`` of a group have it, less how many don't."""
    signs = (F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1) for b in range(BITS))
    return rows.groupBy(*keys).agg(F.array(*signs).alias("sums"))


def bits_where(test) -> Column:
    """The bits whose element of ``sums`` passes."""
    return reduce(lambda x, y: x.bitwiseOR(y), (F.when(test(F.get("sums", b)), F.lit(_bit(b))).otherwise(F.lit(0)).cast("long") for b in range(BITS)))


def blocks(fingerprint: Column, fixed: Column) -> list[Column]:
    """The fixed bits of a fingerprint, by block."""
    width = BITS // BLOCKS
    part = [reduce(lambda x, y: x | y, (_bit(b) for b in range(k * width, (k + 1) * width))) for k in range(BLOCKS)]
    return [fingerprint.bitwiseAND(fixed).bitwiseAND(F.lit(m)) for m in part]


def kinds_of(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item_id, words, item (a hash of the words), k (words of its shingles), size (shingles) of the items with a word."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words")).withColumn("item", F.xxhash64("words")).where("size(words) > 0")
    return items.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE))).withColumn("size", F.size("words") - F.col("k") + 1)


def windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item, similarity, start, n_words): every window that passes, with the item's kind. See :func:`leaks`."""
    items = kinds_of(benchmark, item_id, item_text)
    kinds = cut(items.dropDuplicates(["item"]).select("item", "words", "k", "size"))
    lengths = [r[0] for r in kinds.select("k").distinct().orderBy("k").collect()]  # five values at most
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("words"))

    found = None
    for k in lengths:
        own = kinds.where(F.col("k") == k)
        item_places = cut(_places(own, ["item", "size"], k, F.lit(1), F.col("size")))
        need = F.expr("int((4 * (size + length) + 8) div 9)")
        known = item_places.select("item", "size", "h").distinct()
        long = texts.where(F.size("words") >= k).withColumn("last", F.size("words") - (k - 1))
        hits = _places(long.select("doc_id", "text_hash", "last", "words"), ["doc_id", "text_hash", "last"], k, F.lit(1), F.col("last")).join(sized(known), "h")
        grouped = hits.groupBy("doc_id", "text_hash", "last", "item", "size").agg(F.count("*").alias("n"), F.collect_set("pos").alias("at")).withColumn("length", F.least("last", "size")).withColumn("need", need).where("size(at) >= need").withColumn("at", F.sort_array("at"))
        begins = F.filter(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda i: F.get("at", i + F.col("need") - 2) - F.get("at", i - 1) < F.col("length"))
        pairs = cut(grouped.select("doc_id", "text_hash", "item", "size", "length", F.explode(F.array_distinct(F.transform(begins, lambda i: F.least(F.get("at", i - 1), F.col("last") - F.col("length") + 1)))).alias("start")))
        opened = pairs.select("doc_id", "text_hash", "size", "length", "start").distinct()
        per_text = cut(opened.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "size", "length")).alias("windows")).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"))
        side = sized(per_text, F.size("windows"))
        chosen = long.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).dropDuplicates(["doc_id", "text_hash"])
        opened = chosen.select("doc_id", "text_hash", "words", F.explode("windows").alias("w")).select("doc_id", "text_hash", "words", F.col("w.start").alias("start"), F.col("w.size").alias("size"), F.col("w.length").alias("length"))
        window = ["doc_id", "text_hash", "start", "size", "length"]
        shingles = cut(_places(opened, window, k, F.col("start"), F.col("length")))
        # SimHash: the pairs whose window agrees with the item wherever a passing one must
        prints = bit_sums(shingles, window).select(*window, bits_where(lambda x: x > 0).alias("print"))
        beyond = 2 * (F.col("size") - F.expr("int((8 * size + 8) div 9)"))
        index = cut(bit_sums(item_places, ["item", "size"]).select(F.col("item").alias("_item"), bits_where(lambda x: x > 0).alias("own"), bits_where(lambda x: F.abs(x) > beyond).alias("fixed")))
        near = reduce(lambda x, y: x & y, (x == y for x, y in zip(blocks(F.col("print"), F.col("fixed")), blocks(F.col("own"), F.col("fixed")))))
        same = lambda names: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
        met = pairs.join(prints.withColumnsRenamed({c: f"_{c}" for c in window}), same(window)).select(*pairs.columns, "print")
        pairs = met.join(sized(index), same(["item"]) & near).select(*pairs.columns)
        have = shingles.groupBy(*window, "h").agg(F.count("*").alias("n"))
        want = cut(item_places.groupBy("item", "h").agg(F.count("*").alias("m")))
        common = pairs.join(have.withColumnsRenamed({c: f"_{c}" for c in window}), same(window))
        scored = common.join(sized(want), ["item", "h"]).groupBy(*window, "item").agg(F.sum(F.least("n", "m")).alias("both"))
        passed = scored.select("doc_id", "text_hash", "item", (F.col("both") / (F.col("size") + F.col("length") - F.col("both"))).alias("similarity"), "start", (F.col("length") + (k - 1)).alias("n_words")).where(F.col("similarity") >= SIMILARITY)
        found = passed if found is None else found.unionByName(passed)
    if found is None:
        none = docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).cast("long").alias("item"))
        return none.select("doc_id", "text_hash", "item", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words")).where("false")
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window for each text and item that pass.

    A window has as many words as the item, or is the whole text where that is
    shorter. Words are split at white space and lower-cased. Items of fewer than five
    words are one shingle, and match as a whole; items and texts that are null
    or blank match nothing. Ties go to the first of
    the windows that begin with a place of the item's shingles. Repeated items each
    match; rows with the same doc_id are told apart by their text and reported
    once for the id; null ids are kept as a value. Empty tables give no row, and
    other columns are not read.
    """
    best = windows(docs, benchmark, doc_id, text, item_id, item_text).groupBy("doc_id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    names = cut(kinds_of(benchmark, item_id, item_text).select("item", "item_id"))
    return best.join(sized(names), "item").select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start_word"), F.col("b.n_words").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has a passing window.

    A row goes for its own text only, whatever other rows have its id; null
    and empty texts stay, repeated rows stay or go together, ids may be null,
    an empty table on either side takes nothing away, other columns stay.
    """
    leaked = cut(windows(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_leaked"), F.col("text_hash").alias("_hash")).distinct())
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(sized(leaked), F.col(doc_id).eqNullSafe(F.col("_leaked")) & (own == F.col("_hash")), "left_anti")
