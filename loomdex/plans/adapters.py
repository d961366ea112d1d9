"""The data folder's tables as files, chunks, vectors and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.config import ChunkConfig
from loomdex.operators.chunking.lines import line_windows
from loomdex.sources import table

#: Windows of 8 lines make several chunks of most documents.
SMALL = ChunkConfig(lines=8, overlap=2)


def path_of(doc_id: Column, source: Column) -> Column:
    return F.concat(source, F.lit("/"), F.lpad(doc_id.cast("string"), 12, "0"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a project for each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("project_id"),
        path_of(F.col("doc_id"), F.col("source")).alias("relative_path"),
        F.col("text").alias("content"),
        F.lit("text").alias("language_id"),
        "doc_id",
    )


def chunks(spark: SparkSession, sf_dir: str, config: ChunkConfig = SMALL) -> DataFrame:
    return line_windows(files(spark, sf_dir), config)


def cached_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that has the chunks of even documents, whose entries expire day by day."""
    even = line_windows(files(spark, sf_dir).where("doc_id % 2 = 0"), SMALL)
    day = F.regexp_extract("relative_path", r"(\d+)\.txt$", 1).cast("int") % 60
    expires = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=day)
    return even.groupBy("hash").agg(F.max(expires).alias("expires_at"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files after some changes: every 10th is gone, every 7th is longer, every 11th has a copy."""
    now = files(spark, sf_dir).where("doc_id % 10 <> 0")
    content = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    edited = now.withColumn("content", content)
    copies = edited.where("doc_id % 11 = 0").withColumn("relative_path", F.concat("relative_path", F.lit(".copy")))
    return edited.unionByName(copies)


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file events of a project for each user; a purchase is a sync."""
    kind = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type").isin("view", "click"), "update")
        .when(F.col("event_type") == "error", "delete")
        .otherwise("sync")
    )
    path = F.concat(F.lit("src/f"), F.get_json_object("props", "$.k"), F.lit(".ts"))
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("project_id"), path.alias("path"), kind.alias("event_type"), "ts", "event_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of the vector index; a tenant for each label."""
    return table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("id"), F.col("label").alias("tenant"), "embedding", "vec_id"
    )
