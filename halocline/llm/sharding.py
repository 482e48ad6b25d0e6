"""Sharding: a keyed Feistel permutation of global row numbers.

Row numbers come from a fixed total order (hash bucket, then id, checksum and
size inside it), never from partition ids, so that a lost executor or another
number of partitions gives the same shards. A row's shard and slot are then
arithmetic on its permuted number; no row has to look at another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.text import mix
from halocline.session import ship

#: Buckets of the total order; their counts are the only table that is broadcast, and a bucket is what one task sorts.
BUCKETS = 1 << 14
ROUNDS = 6


def feistel(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network over the next even power of two, walked until inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def row_numbers(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``row_no`` (0-based, gapless) and ``n_rows``; rows that agree in ``order`` are interchangeable."""
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), F.sum("_n").over(every).alias("n_rows"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    numbered = keyed.withColumn("_rank", F.row_number().over(inside).cast("long"))
    return numbered.join(F.broadcast(starts), "_bucket").withColumn("row_no", F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_start", "_rank")


def permuted(row_no: Column, n_rows: Column, seed: int) -> Column:
    """Column form of :func:`feistel`."""

    @F.pandas_udf(T.LongType())
    def run(number: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), int(total.iloc[0]), seed) if len(number) else [], dtype="int64")

    return run(row_no, n_rows)


def shard(docs: DataFrame, n_shards: int, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law ``rows``.

    size is the text's UTF-8 bytes plus 8. Null and empty texts have no bytes
    (size 8, checksum 0); a null id is an ordinary value; repeated rows get
    slots of their own; an empty table gives none; other columns are not read.
    Shard k takes the permuted numbers k, k + n_shards, ...: row counts differ
    by one at most and slots have no gap.
    """
    ship(docs.sparkSession)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"))
    at = row_numbers(narrow, ["doc_id", "text_crc32", "size"]).withColumn("_at", permuted(F.col("row_no"), F.col("n_rows"), seed))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_at") % n_shards).cast("int").alias("shard"), F.expr(f"_at div {n_shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
