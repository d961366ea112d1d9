"""Synchronisation of projects with the index: init, check, the two phases, and the whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import EngineConfig
from loomdex.functions.hashing import vector_id
from loomdex.functions.vectors import is_zero
from loomdex.operators import cache as caches
from loomdex.operators import merkle, models, vector_index
from loomdex.operators.chunking.ast_chunks import chunk_files
from loomdex.operators.telemetry import Telemetry
from loomdex.operators.upsert import latest_by_key
from loomdex.runtime import materialize

TENANT = ["user_id", "project_id"]


@dataclass
class State:
    """Tables of the server: embeddings by hash, vectors by id, roots by tenant; and the chunks that each file has."""

    cache: DataFrame  # hash, summary, embedding, expires_at
    vectors: DataFrame  # id, user_id, project_id, hash, summary, ..., embedding, version, seq
    roots: DataFrame  # user_id, project_id, root
    chunks: DataFrame | None = None  # user_id, project_id, relative_path, hash


def phase1(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``(project_id, received, hits, needed, vectorized)``: what phase 1 answers, counted by project.

    vectorized is the number of vectors stored for hits: copies of one hash in a project are one.
    """
    hits = caches.with_hits(chunks, cache)
    return hits.groupBy("project_id").agg(
        F.count("*").alias("received"),
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("needed"),
        F.count_distinct(F.when(F.col("hit"), F.col("hash"))).alias("vectorized"),
    )


def categorize(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """``(hash, state)`` of each chunk row in hash-only mode: ``cached`` or ``needed``."""
    return caches.with_hits(chunks, known).select("project_id", "hash", F.when(F.col("hit"), "cached").otherwise("needed").alias("state"))


def process(
    chunks: DataFrame, state: State, now: Column, version: int, summarizer=models.template_summarizer, embedder=None,
    config: EngineConfig = EngineConfig(), telemetry: Telemetry | None = None,
):
    """Summarize, embed and store ``chunks(user_id, project_id, hash, code, seq, ...)``; (new state, counts by project).

    Chunks that the cache has reuse its entry; the others are worked on once each. Zero vectors mark failures:
    they are neither cached nor stored, but count as processed, and make the status ``partial``.
    """
    watch = telemetry or Telemetry()
    known = caches.latest(caches.alive(state.cache, now)).select("hash", "summary", "embedding")
    zero = is_zero(F.col("embedding"))
    # Code and summaries are moved with their hash only; rows of chunks go without them.
    looked = chunks.drop("code").join(known.select("hash", zero.alias("zero"), F.lit(True).alias("hit")), "hash", "left")
    looked = looked.withColumn("hit", F.coalesce("hit", F.lit(False)))
    looked = materialize(watch.observe(looked, "lookup", received=F.count("*"), hits=F.count_if("hit")), "looked")
    hits, misses = looked.where("hit"), looked.where("not hit").drop("zero")
    unknown = chunks.join(hits.select("hash").distinct(), "hash", "left_anti").where(F.col("hash").isNotNull())
    made = materialize(models.embed(models.summaries(unknown, summarizer, config), "summary", embedder, config), "made")
    worked = misses.join(made.select("hash", zero.alias("zero")), "hash")
    worked = materialize(watch.observe(worked, "models", processed=F.count("*"), failed=F.count_if("zero")), "worked")
    cache = caches.put(state.cache, made.where(~zero), now, config.embedding_ttl_days, distinct=True)
    # Cached rows precede new ones; each in the order of the input.
    every = hits.unionByName(worked).withColumn("version", F.lit(version)).withColumn("seq", F.struct(~F.col("hit"), "seq"))
    id_ = vector_id(F.col("user_id"), F.col("project_id"), F.col("hash"), True)
    last = latest_by_key(every.where("not zero").drop("zero", "hit").withColumn("id", id_), ["id"], ["version", "seq"]).drop("id")
    vectors = vector_index.to_rows(last.join(known.unionByName(made), "hash"))
    if state.vectors is not None:
        vectors = vector_index.upsert(state.vectors, vectors.select(*state.vectors.columns))
    counts = every.groupBy(*TENANT).agg(
        F.count("*").alias("received"),
        F.count_if(~F.col("hit")).alias("processed"),
        F.count_if("hit").alias("hits"),
        F.count_distinct(F.when(~F.col("zero"), F.col("hash"))).alias("stored"),
        F.when(F.bool_or("zero"), "partial").otherwise("indexed").alias("status"),
    )
    vectors = materialize(watch.observe(vectors, "upsert", vectors=F.count("*")), "vectors")
    return State(materialize(cache, "cache"), vectors, state.roots, state.chunks), counts


def put_roots(roots: DataFrame, new: DataFrame) -> DataFrame:
    both = roots.withColumn("__v", F.lit(0)).unionByName(new.select(*roots.columns).withColumn("__v", F.lit(1)))
    return latest_by_key(both, TENANT, ["__v"]).select(*roots.columns)


def sync(
    files: DataFrame, state: State, now: Column, version: int, config: EngineConfig = EngineConfig(), dirty: DataFrame | None = None,
    store_roots: Callable[[DataFrame], None] | None = None, telemetry: Telemetry | None = None, **providers,
):
    """Bring the index up to date with ``files(user_id, project_id, relative_path, content, language_id)``.

    Projects whose Merkle root is the server's are left alone before anything is chunked. The others' files are cut by
    syntax where their language is known, else by lines: all of them, or only those in ``dirty(user_id, project_id,
    relative_path)`` if the state knows the chunks of the rest. Chunks are processed, and vectors of chunks that no file of the
    project has any more are deleted. ``store_roots`` gets the table of roots to be stored: when all is done, so that a failed
    run is repeated, or before anything is with the commit mode ``first``. Returns (new state, counts by project).
    """
    mine = materialize(merkle.roots(merkle.leaves(files)), "mine")
    changed = materialize(merkle.check_roots(mine, state.roots).where("changed").select(*TENANT), "changed")
    roots = materialize(put_roots(state.roots, mine), "roots")
    if store_roots and config.commit_mode == "first":
        store_roots(roots)
    todo = files.join(changed, TENANT, "left_semi")
    path = [*TENANT, "relative_path"]
    none = files.sparkSession.createDataFrame([], "user_id string, project_id string, relative_path string, hash string")
    known = none if state.chunks is None else state.chunks
    kept = known.join(changed, TENANT, "left_anti")
    if dirty is not None and state.chunks is not None:
        todo = todo.join(dirty.select(*path).distinct(), path, "left_semi")
        rest = known.join(changed, TENANT, "left_semi").join(files.select(*path), path, "left_semi")
        kept = kept.unionByName(rest.join(dirty.select(*path).distinct(), path, "left_anti"))
    chunks = chunk_files(todo, config.chunks).withColumnRenamed("text", "code")
    chunks = materialize(chunks.withColumn("seq", F.struct("relative_path", "line_start")), "chunks")
    manifest = materialize(kept.unionByName(chunks.select(*path, "hash").distinct()), "manifest")
    if state.vectors is not None:
        # Before new ones come, which all have files: so vectors are written once.
        here = manifest.select(*TENANT, "hash").distinct()
        theirs = state.vectors.join(changed, TENANT, "left_semi").join(here, [*TENANT, "hash"], "left_semi")
        state = replace(state, vectors=state.vectors.join(changed, TENANT, "left_anti").unionByName(theirs.select(*state.vectors.columns)))
    after, counts = process(chunks, state, now, version, config=config, telemetry=telemetry, **providers)
    if store_roots and config.commit_mode == "last":
        store_roots(roots)
    return State(after.cache, after.vectors, roots, manifest), counts
