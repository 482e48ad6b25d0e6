"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents`` (the last one: ids). Between two
stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import bpe, decontaminate, language, secret_scan, simhash
from halocline.llm.text import small_batches
from halocline.session import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts whose language is plain; the models learn from the labelled rows that aren't held out.

    Null texts, texts without a letter and those with a narrow margin go;
    without labels there is no model, and all go. Repeated rows are judged
    alike; an empty table stays empty; other columns stay as they are.
    """
    small_batches(spark)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    return docs.where(language.accepts(F.col("text"), model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one text of each SimHash component: of its smallest id, of one with equal ids the least text hash.

    Texts without a word are one component; null ids come last; of repeated
    rows one stays; an empty table stays empty; other columns stay as they are.
    """
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts without a benchmark item.

    A row goes for its own text only; null and empty texts stay; repeated rows
    stay or go together; an empty table stays empty; other columns stay as they are.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in every text; n_chars follows.

    Every row stays; null texts stay null and keep their n_chars; repeated rows
    are redacted alike; an empty table stays empty; other columns stay as they are.
    """
    ledger = secret_scan.Ledger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(docs)
    clean = secret_scan.redact(docs, ledger.findings())
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the SHA-256 of what the ids decode to, of every row.

    Null and empty texts have no ids; repeated rows are encoded each for itself;
    null ids of documents stay; an empty table gives no row; other columns are left out.
    """
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs, ranks), ranks)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Compression, XXH64 and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a table in the shared folder after each."""
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
