"""The corpus pipeline: stages that each apply one operator to all that the stage before
it kept. Every stage but the last returns the columns of ``documents``; the last
adds what the mix takes of each document (``taken`` words), and leaves out none.

Texts are changed where a decision asks for it: benchmark passages below the coverage
limit are cut out, personal data is replaced by its kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from menuloom.llm import common, decontamination, minhash, mixing, pii, toxicity
from menuloom.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = mixing.word_count()
    return mixing.mix(docs, size, mixing.prose_quality(size))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("mixing", mix),
]

#: Toxicity is a trained model, which SQL cannot express; the tests compare the stages with
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written to the shared folder and read
    again; a stage's table goes once the next one is there."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
