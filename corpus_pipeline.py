"""A training corpus from ``documents``: language ID, near-duplicate removal, decontamination, redaction, mixing.

Each stage takes what the stage before it kept and returns it with its decisions in effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteline.llm import decontam, langid, mixing, secrets, simhash
from siteline.llm.common import read, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts that are null, without letters or of no likely language go."""
    return langid.keep_identified(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: SimHash candidates, linked at a five-word similarity of 0.8."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with ``benchmark``."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with the words taken and the number of whole repetitions."""
    return mixing.sampled(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", remove_near_copies),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: No SQL: language ID is a trained network, and near copies are components of a similarity graph.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet below the folder for checkpoints and read again.

    A stage's folder goes once the next one is written; the last stays, as the result reads it.
    """
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{before}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = name
    return docs
