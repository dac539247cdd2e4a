"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

1. toxicity: documents called toxic by their nearest labelled examples go.
2. near_duplicates: of each component of documents that share 0.8 or more of their 5-word shingles, the one of the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: spans of credentials are masked in the text; n_chars follows it.
5. tokens: SentencePiece ids of the kept texts, in (doc_id, n_tokens, ids).

Nulls, empty texts, repeated rows, empty tables and further columns have the results that the operators' modules state; all stages but the last
return the columns of documents as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard_join, piece_scan, secrets, toxicity
from quillon.llm.common import scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = piece_scan.encode_docs(docs, piece_scan.model_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("tokens", encode_tokens),
]

#: Learned models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
