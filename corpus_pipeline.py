"""The corpus pipeline: five of the corpus operators in turn, each over all that its predecessor kept."""

# Defined results, of every stage: a null text is empty text to the decision and stays null in the row; repeated rows are decided alike;
# empty tables give empty tables; very long texts are read whole; all but the last return the columns of
# their input, whatever their names and whatever else they hold. Ties: of near-duplicates the least id stays.

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, langid, packing, secrets, simhash


#: Rows in a batch between Spark and Python. Texts are long, and both sides hold a batch several times.
BATCH_ROWS = 2000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected."""
    _bounded(spark)
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates."""
    _bounded(spark)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    _bounded(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact secrets; every document stays."""
    _bounded(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    _bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Compression, XXH64 and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: stage[1](spark, docs, sf_dir), STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
