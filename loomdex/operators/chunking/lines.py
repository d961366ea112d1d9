"""Overlapping windows of lines, and chunks read back by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import ChunkConfig
from loomdex.functions.hashing import chunk_hash
from loomdex.functions.text import group_sums, lines, running_sums, sum_before, trim
from loomdex.operators.tenants import file_key


def line_windows(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of ``files(project_id, relative_path, content, language_id)`` by windows of lines.

    A window starts at every ``lines - overlap`` lines, so the last one may lie within the one before. Its
    text is trimmed, and windows shorter than ``min_chunk`` then go; offsets are those of the untrimmed window.
    Offsets and sizes count code points. Files of null content have no chunks. With a ``user_id``, files are kept apart by it.
    """
    step, key = config.lines - config.overlap, file_key(files)
    split = files.where(F.col("content").isNotNull()).select(*key, "language_id", lines(F.col("content")).alias("l"))
    # Lengths of runs of ``step`` lines with their line ends: offsets of windows are sums of them.
    run = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("l") / step).cast("int") - 1),
        lambda i: F.length(F.array_join(F.slice("l", i * step + 1, F.lit(step)), "\n")) + 1,
    )
    summed = split.withColumn("runs", run).withColumn("within", running_sums(F.col("runs"))).withColumn("before", group_sums(F.col("within")))
    # A file's windows are made in one expression: its lines aren't copied to each of them.
    windows = F.transform(
        F.sequence(F.lit(0), F.size("l") - 1, F.lit(step)),
        lambda at: F.struct(
            (at + 1).alias("line_start"),
            F.least(at + config.lines, F.size("l")).alias("line_end"),
            sum_before(F.col("within"), F.col("before"), (at / step).cast("int")).cast("int").alias("char_start"),
            F.array_join(F.slice("l", at + 1, F.lit(config.lines)), "\n").alias("raw"),
        ),
    )
    placed = summed.select(*key, "language_id", F.explode(windows).alias("w")).select(*key, "language_id", "w.*").withColumn("text", trim(F.col("raw")))
    return placed.where(F.length("text") >= config.min_chunk).select(
        *key,
        chunk_hash(F.col("text")).alias("hash"),
        F.lit("block").alias("type"),
        F.lit(None).cast("string").alias("name"),
        "language_id",
        "line_start",
        "line_end",
        "char_start",
        (F.col("char_start") + F.length("raw")).alias("char_end"),
        F.length("text").alias("char_count"),
        "text",
    )


def line_count() -> Column:
    """Number of lines of a chunk."""
    return F.col("line_end") - F.col("line_start") + 1


def file_payload(chunks: DataFrame) -> DataFrame:
    """``(..., relative_path, payload, n)``: the hashes of each file in order of their lines, and their number."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_start", "hash"))), lambda s: s["hash"])
    return chunks.groupBy(*file_key(chunks)).agg(ordered.alias("payload"), F.count("*").alias("n"))


def read_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``chunks`` with ``code``, the characters that their references name; chunks of missing files go."""
    key = [c for c in file_key(chunks) if c in files.columns]
    code = F.substring(F.col("content"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return chunks.join(files.select(*key, "content"), key).withColumn("code", code).drop("content")
