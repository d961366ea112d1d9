"""Caches keyed by content hash: lookup, expiry, refresh."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.operators.upsert import latest_by_key


def alive(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that expire after ``as_of``; one that expires at it is gone."""
    return cache.where(F.col("expires_at") > as_of)


def with_hits(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` with ``hit``: whether the cache has their hash. One row for each row of chunks."""
    known = cache.select("hash").distinct().withColumn("hit", F.lit(True))
    return chunks.join(known, "hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def latest(cache: DataFrame) -> DataFrame:
    """One entry of each hash: that which expires last; of entries alike in that, the same one in every run."""
    rows = cache.withColumn("__k", F.xxhash64(*cache.columns))
    return latest_by_key(rows, ["hash"], ["expires_at", "__k"]).select(*cache.columns)


def split(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that the cache has, with its columns, and those that it hasn't, row for row."""
    known = latest(cache)
    return chunks.join(known, "hash"), chunks.join(known, "hash", "left_anti")


def needed(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Hashes to be sent: one for each missing row, not distinct."""
    return chunks.join(cache.select("hash"), "hash", "left_anti").select("project_id", "hash")


def needed_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of ``chunks`` whose hash is wanted."""
    return chunks.join(wanted.select("hash").distinct(), "hash", "left_semi")


def hit_rate(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``(..., hit_rate)`` of rows with ``hit``: the share that the cache had, to 6 decimals."""
    return hits.groupBy(*keys).agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def savings(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``(..., saved)``: percentage of chunks whose code needn't be sent, to one decimal."""
    share = 100.0 * F.count_if("hit") / F.nullif(F.count("*"), F.lit(0))
    return hits.groupBy(*keys).agg(F.round(share, 1).alias("saved"))


def summary(hits: DataFrame) -> DataFrame:
    """One row ``(received, cached, sent, projects, message)`` of what a sync did."""
    message = F.concat(F.lit("synced "), F.count("*").cast("string"), F.lit(" chunks"))
    return hits.agg(
        F.count("*").alias("received"), F.count_if("hit").alias("cached"), F.count_if(~F.col("hit")).alias("sent"),
        F.count_distinct("project_id").alias("projects"), message.alias("message"),
    )


def put(cache: DataFrame, rows: DataFrame, now: Column, ttl_days: int, distinct: bool = False) -> DataFrame:
    """The cache after ``rows`` were stored at ``now``; of one hash the later entry stays.

    ``distinct`` says that rows have each hash once: they are then taken as they are, and only older entries are shuffled.
    """
    fresh = rows.withColumn("expires_at", now + F.make_interval(days=F.lit(ttl_days)))
    columns = cache.columns
    if distinct:
        return latest(cache).join(rows.select("hash"), "hash", "left_anti").select(*columns).unionByName(fresh.select(*columns))
    both = cache.withColumn("__v", F.lit(0)).unionByName(fresh.select(*columns).withColumn("__v", F.lit(1)))
    both = both.withColumn("__k", F.xxhash64(*columns))
    return latest_by_key(both, ["hash"], ["__v", "expires_at", "__k"]).select(*columns)


def refresh(cache: DataFrame, seen: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """The cache after ``seen(hash)`` was looked up: entries found live on for ``ttl_days``."""
    found = seen.select("hash").distinct().withColumn("__seen", F.lit(True))
    later = now + F.make_interval(days=F.lit(ttl_days))
    touched = F.when(F.col("__seen") & (F.col("expires_at") > now), later).otherwise(F.col("expires_at"))
    return cache.join(found, "hash", "left").withColumn("expires_at", touched).select(*cache.columns)


def literal_time(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp")
