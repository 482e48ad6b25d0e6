"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import bpe, decontaminate, language, quality, secret_scan, sharding, simhash, substrings, suffixes, warc
from halocline.session import scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~held))
    return language.classify(docs, model).withColumn("held_out", held)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) as long)")
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
    return warc.read(files).select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secret_scan.Ledger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(docs)
    rows = secret_scan.to_paths(docs, ledger.findings())
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    return rows.select("doc_id", *(of(r.kind) for r in secret_scan.BASE), F.sha2(secret_scan.rendered(base), 256).alias("base_sha256"), secret_scan.rendered(F.col("spans")).alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_suffix_dedup, op4_decontamination, op5_sharding, op6_substring_dedup, op7_warc, op8_simhash, op9_secret_scan, op10_bpe)}
