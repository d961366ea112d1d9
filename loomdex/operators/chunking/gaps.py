"""Blocks for the lines that no chunk covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.config import ChunkConfig
from loomdex.functions.hashing import chunk_hash
from loomdex.functions.text import group_sums, lines, running_sums, sum_before, trim
from loomdex.operators.tenants import file_key


def fill_gaps(intervals: DataFrame, files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Gap blocks of files with ``intervals(project_id, relative_path, line_start, line_end, seq)``.

    A gap reaches from the line after the previous chunk, in order of line_start and seq, to the line before the
    next; the last one to the end of the file. Its text is trimmed; gaps shorter than ``min_chunk`` go.
    """
    key = file_key(files)
    in_file = Window.partitionBy(*key).orderBy("line_start", "seq")
    before = intervals.select(
        *key,
        (F.lag("line_end", 1, 0).over(in_file) + 1).alias("a"),
        (F.col("line_start") - 1).alias("z"),
    )
    after = intervals.groupBy(*key).agg((F.max_by("line_end", F.struct("line_start", "seq")) + 1).alias("a"))
    gaps = before.where("a <= z").unionByName(after.withColumn("z", F.lit(None).cast("int")))
    # A file meets its gaps as one list: its lines aren't copied to each of them.
    listed = gaps.groupBy(*key).agg(F.collect_list(F.struct("a", "z")).alias("gaps"))
    split = files.where(F.col("content").isNotNull()).select(*key, "language_id", lines(F.col("content")).alias("l")).join(listed, key)
    summed = split.withColumn("sizes", F.transform("l", lambda x: F.length(x) + 1)).withColumn("within", running_sums(F.col("sizes")))
    summed = summed.withColumn("before", group_sums(F.col("within")))
    last = lambda g: F.coalesce(g["z"], F.size("l"))
    cut = F.transform(
        F.filter("gaps", lambda g: g["a"] <= last(g)),
        lambda g: F.struct(
            g["a"].alias("line_start"),
            last(g).alias("line_end"),
            sum_before(F.col("within"), F.col("before"), g["a"] - 1).cast("int").alias("char_start"),
            F.array_join(F.slice("l", g["a"], last(g) - g["a"] + 1), "\n").alias("raw"),
        ),
    )
    found = summed.select(*key, "language_id", F.explode(cut).alias("g")).select(*key, "language_id", "g.*").withColumn("text", trim(F.col("raw")))
    return found.where(F.length("text") >= config.min_chunk).select(
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
