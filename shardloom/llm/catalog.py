"""The registered queries of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.llm import (backoff_lm, benchmark_index, byte_bpe, filter_audit, jaccard_join, packing, posting_lists,
                           secret_scan, token_alignment, token_counts, token_files, toxicity, winnowing)
from shardloom.llm.common import crc_of_id, table
from shardloom.session import fresh_dir

TOKEN_LIMIT = 4096


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return posting_lists.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    path = fresh_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over the limit."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


def repository():
    return F.concat_ws("/", "source", "lang")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, a language of it a repository."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), repository=repository(), owner=F.col("source"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 85 percent of their four-word shingles."""
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of nine tenths of them."""
    return backoff_lm.score(table(spark, sf_dir, "documents"), F.pmod(crc_of_id(), F.lit(10)) == 0)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    stream = packing.token_stream(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(stream)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), F.pmod(crc_of_id(), F.lit(5)) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    score = toxicity.scorer(toxicity_model(spark, docs, sf_dir))
    scored = docs.select("doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"),
                         score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two vocabularies, aligned and weighed by corpus-wide counts."""
    linked, _ = token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))
    return linked


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order of them, per language."""
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of benchmark items in every document."""
    found = benchmark_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias(
        "items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (
    op1_posting_lists, op2_token_files, op3_token_counts, op4_byte_bpe, op5_secret_scan, op6_jaccard_join, op7_backoff_lm,
    op8_winnowing, op9_packing, op10_toxicity, op11_token_alignment, op12_filter_audit, op13_benchmark_index)}
ORACLES = {"op12_filter_audit": filter_audit.oracle(), "op13_benchmark_index": benchmark_index.ORACLE}
