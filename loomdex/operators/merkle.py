"""Merkle roots of projects: hashes of files folded in pairs, in order of path."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.hashing import file_hash
from loomdex.operators.ranking import with_positions
from loomdex.operators.tenants import file_key, owner
from loomdex.operators.upsert import latest_by_key
from loomdex.runtime import materialize

#: Leaves that one row folds: a power of two, so that subtrees are aligned.
FOLD = 256


def leaves(files: DataFrame) -> DataFrame:
    """``(project_id, relative_path, hash)`` of files with content; with their ``user_id``, if files have it.

    So have all tables made of leaves: two users' projects of one id are two projects.
    """
    hash_ = file_hash(F.col("relative_path"), F.col("content"))
    return files.where(F.col("content").isNotNull()).select(*file_key(files), hash_.alias("hash"))


def in_order(tree: DataFrame) -> DataFrame:
    """Leaves with ``idx``, their position by path in a locale's order (``_ < a < A < b``)."""
    order = [F.collate(F.col("relative_path"), "UNICODE"), F.col("relative_path")]
    return with_positions(tree, owner(tree), order)


def _above(hashes: Column) -> Column:
    """The level above a run of hashes: pairs are hashed as hex, an odd last one moves up unchanged."""
    pair = F.transform(
        F.sequence(F.lit(0), ((F.size(hashes) - 1) / 2).cast("int")),
        lambda i: F.when(
            2 * i + 1 < F.size(hashes),
            F.sha2(F.concat(F.get(hashes, (2 * i).cast("int")), F.get(hashes, (2 * i + 1).cast("int"))), 256),
        ).otherwise(F.get(hashes, (2 * i).cast("int"))),
    )
    return F.when(F.size(hashes) <= 1, hashes).otherwise(pair)


#: Levels that a run of FOLD hashes has above it.
ROUNDS = FOLD.bit_length() - 1


def _fold(hashes: Column) -> Column:
    """The root of up to FOLD hashes."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), hashes, lambda acc, _: _above(acc)), F.lit(0))


def _levels(hashes: Column) -> Column:
    """The ROUNDS levels above up to FOLD hashes, from below; the last one is the root alone."""
    every = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.array(hashes), lambda acc, _: F.concat(acc, F.array(_above(F.element_at(acc, -1)))))
    return F.slice(every, 2, ROUNDS)


def _runs(level: DataFrame, key: list[str]) -> DataFrame:
    """``(project_id, idx, h)``: aligned runs of FOLD nodes, the hashes of each in order."""
    run = level.groupBy(*key, F.floor(F.col("idx") / FOLD).alias("idx"))
    return run.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx"), "hash"))), lambda s: s["hash"]).alias("h"))


def roots(tree: DataFrame) -> DataFrame:
    """``(project_id, root, n_files)``. Each pass folds aligned runs of FOLD nodes, whatever a project's size."""
    key = owner(tree)
    level = in_order(tree).select(*key, "idx", "hash")
    sizes = tree.groupBy(*key).agg(F.count("*").alias("n_files"))
    most = sizes.agg(F.max("n_files")).first()[0] or 0
    while True:
        level = _runs(level, key).select(*key, "idx", _fold(F.col("h")).alias("hash"))
        most = -(-most // FOLD)
        if most <= 1:
            break
    return level.select(*key, F.col("hash").alias("root")).join(sizes, key)


def nodes(tree: DataFrame) -> DataFrame:
    """``(project_id, level, idx, hash)`` of all nodes, leaves being level 0.

    Each pass makes ROUNDS levels of aligned runs of FOLD nodes, so that a project of any size is dealt over many tasks.
    """
    key = owner(tree)
    out = level = in_order(tree).select(*key, F.lit(0).alias("level"), "idx", "hash")
    sizes = materialize(tree.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    most, k = sizes.agg(F.max("n")).first()[0] or 0, 0
    sizes = sizes.select("n", *[F.col(c).alias(f"__{c}") for c in key])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    while most > 1:
        folded = materialize(_runs(level, key).select(*key, "idx", _levels(F.col("h")).alias("levels")), "folded")
        above = folded.join(sizes, same).select(*key, "n", "idx", F.posexplode("levels").alias("j", "h"))
        # A project's levels end with its root.
        above = above.where(F.col("n") > F.lit(2.0) ** (F.col("j") + k)).withColumn("first", (F.col("idx") * F.lit(FOLD // 2) / F.lit(2.0) ** F.col("j")).cast("long"))
        placed = above.select(*key, (F.col("j") + k + 1).alias("level"), "first", F.posexplode("h").alias("i", "hash"))
        out = out.unionByName(placed.select(*key, "level", (F.col("first") + F.col("i")).alias("idx"), "hash"))
        level = folded.select(*key, "idx", F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"))
        most, k = -(-most // FOLD), k + ROUNDS
    return out


def check_roots(client: DataFrame, server: DataFrame) -> DataFrame:
    """``(user_id, project_id, changed, server_root)``: changed unless the server has the same root."""
    known = server.select("user_id", "project_id", F.col("root").alias("server_root"))
    met = client.join(known, ["user_id", "project_id"], "left")
    return met.select("user_id", "project_id", (~F.col("root").eqNullSafe(F.col("server_root"))).alias("changed"), "server_root")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(project_id, relative_path, status)`` of two snapshots of leaves: added, removed, modified, unchanged."""
    key = file_key(old)
    a = old.select(*key, F.col("hash").alias("old_hash"))
    b = new.select(*key, F.col("hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(project_id, hash, status)`` of two snapshots of chunks by hash: added, removed, unchanged."""
    key = [*owner(old), "hash"]
    a = old.select(*key).distinct().withColumn("__o", F.lit(True))
    b = new.select(*key).distinct().withColumn("__n", F.lit(True))
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def fold_events(events: DataFrame) -> DataFrame:
    """Files that exist after ``events(project_id, path, event_type, ts, event_id)``: the latest event isn't a delete."""
    last = latest_by_key(events.select("project_id", "path", "event_type", "ts", "event_id"), ["project_id", "path"], ["ts", "event_id"])
    return last.where("event_type <> 'delete'")
