"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns
of documents. Stages behave as the operators that they call do on nulls, empty and very long
texts, repeated rows, empty tables and other columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import exact_dedup, mixing, sentencepiece_codec, simhash_wide, toxicity
from loomdex.runtime import clear_scratch, scratch_root, written
from loomdex.sources import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels of documents, doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the least doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, which are alike in 0.8 or more of their five-word shingles: that of the least doc_id."""
    return simhash_wide.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of each document."""
    coded = sentencepiece_codec.encode(docs)
    return coded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The model, the fingerprints and the draws can't be expressed in SQL; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_root(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path, before = f"{root}/{i}-{name}", written()
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        clear_scratch(spark, before)  # tables that only this stage needed
        docs = spark.read.parquet(path)
    return docs
