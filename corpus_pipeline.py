"""A corpus made ready for training in five stages, each a table that the next one reads.

Toxic documents go; documents whose language can't be told go; one document of each group of near copies stays (sets of 5-word shingles with
a similarity of 0.8 or more); benchmark passages are cut out; texts are encoded.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm import decontamination, language, sentencepiece_lattice, simhash, toxicity
from colweave.llm.common import table
from colweave.storage import delete, scope, shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def with_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece_lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), kept_chunks=20_000, at_a_time=30_000)  # executors still hold memory of former stages
    return out.select("doc_id", "ids", "samples")


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", with_a_language),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece_encoding", encoded),
]

#: SQL can express neither the classifier nor the sampled segmentations; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table in the shared folder. What a stage made on its way, and the table before the last, goes once the stage has been written."""
    docs, folder, former = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scope():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if former:
            delete(spark, f"{folder}/{former}")
        docs, former = spark.read.parquet(f"{folder}/{name}"), name
    return docs
