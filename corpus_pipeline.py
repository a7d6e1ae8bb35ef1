"""From raw documents to packed token sequences, each stage by one operator of ``shardloom.llm``.

1. toxicity: documents that score 0.5 or more go.
2. n-gram Jaccard join: of documents linked by at least 0.8 of their five-word shingles, the one with the least id stays.
3. secret scans: values that look live (few owners hold them) are replaced by a mark; copied examples stay.
4. packing: the texts as token sequences of 4096.

Every stage but the last returns the columns of documents. Null texts pass as they are and count as empty. Rows that share
an id stay or go together, those of them with equal texts stay once; rows without an id count as sharing one. An empty table gives no
pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shardloom.llm import jaccard_join, packing, secret_scan, toxicity
from shardloom.llm.catalog import repository, toxicity_model
from shardloom.llm.common import staged, staged_alone
from shardloom.session import fresh_dir

NO_ID = -(1 << 63)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = toxicity.scorer(toxicity_model(spark, docs, sf_dir))
    return docs.filter(score(F.col("text")) < 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    ids = staged_alone(lambda: staged(jaccard_join.linked_components(docs, k=5, percent=80).groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")), "kept-ids"))
    # Only ids that go or are there several times are looked up; all other texts stay where they are.
    special = ids.filter("not stays or n > 1").select("key", "stays")
    if special.count() <= jaccard_join.SEND_IDS:
        special = F.broadcast(special)
    # A row is one column here, so whatever its columns are called, none of them is touched.
    looked_up = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).join(special, "key", "left")
    others = [F.col(f"row.{c}") for c in ("lang", "source", "n_chars") if c in docs.columns]
    copies = Window.partitionBy("key", "digest").orderBy(*others, F.xxhash64("row"))
    repeated = looked_up.filter("stays").withColumn("digest", F.sha2("row.text", 256)).withColumn(
        "copy", F.row_number().over(copies)).filter("copy = 1")
    return looked_up.filter("stays is null").select("row.*").union(repeated.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact_live(docs, repository=repository(), owner=F.col("source"))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_stream(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_each), ("secret_scan", redact_secrets),
          ("packing", pack_tokens)]
# Learned scores, components and tokens are beyond SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
