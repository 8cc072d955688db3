"""A corpus through five stages; each takes (spark, docs, sf_dir), its result is written as Parquet and read again as the next one's docs.

Documents that are toxic go, one of each group of near copies stays, documents with benchmark passages go, secrets are
redacted, and what is left is encoded. All stages but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import cleanup, forget, table_count, written
from millrace.llm.bpe import bpe_round_trip
from millrace.llm.decontaminate import drop_leaks
from millrace.llm.ngram_join import keep_one
from millrace.llm.secret_scan import redact_secrets
from millrace.llm.toxicity import reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more."""
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``<secret>``; n_chars, where there is such a column, follows the text."""
    out = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: Learned scores and tokenizers can't be put in SQL; tests/llm/test_pipeline.py holds the rows of all stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages before it wrote is deleted as soon as it isn't read any more; the table that the last one reads stays for the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        since = table_count()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            cleanup(spark, docs, since)
            if before is not None:
                forget(before)
            before = docs
    return docs
