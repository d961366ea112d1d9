"""The mode without models: a table of known chunk hashes, whose entries live on when they are seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import EngineConfig
from loomdex.operators import cache


def init(chunks: DataFrame, known: DataFrame, now: Column, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """(known hashes afterwards, ``(project_id, stored, skipped)``): rows of new and of known hashes; all live on."""
    hits = cache.with_hits(chunks, cache.alive(known, now))
    counts = hits.groupBy("project_id").agg(F.count_if(~F.col("hit")).alias("stored"), F.count_if("hit").alias("skipped"))
    return cache.put(known, chunks.select("hash").distinct(), now, config.hash_ttl_days), counts


def phase1(chunks: DataFrame, known: DataFrame, now: Column, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """(known hashes afterwards, ``(project_id, hash, state)``): each row is cached, and then lives on, or needed."""
    hits = cache.with_hits(chunks, cache.alive(known, now))
    told = hits.select("project_id", "hash", F.when(F.col("hit"), "cached").otherwise("needed").alias("state"))
    return cache.refresh(known, chunks, now, config.hash_ttl_days), told


def phase2(chunks: DataFrame, known: DataFrame, now: Column, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Known hashes after the needed chunks arrived."""
    return cache.put(known, chunks.select("hash").distinct(), now, config.hash_ttl_days)
