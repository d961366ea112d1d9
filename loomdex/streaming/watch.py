"""Watching projects: each micro-batch of file changes updates the leaves, and roots that change are reported."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.hashing import file_hash
from loomdex.functions.paths import SCAN_EXTENSIONS, has_extension, is_ignored
from loomdex.operators import merkle
from loomdex.operators.tenants import owner
from loomdex.operators.upsert import latest_by_key
from loomdex.runtime import materialize, scratch_root
from loomdex.streaming.log import BatchLog


class MerkleWatch:
    """A foreachBatch sink for ``(project_id, path, event_type, content, ts, event_id)``, with a user_id or without.

    Events of ignored paths and other extensions are dropped. Leaves are replaced or removed, and
    ``on_changed(roots)`` gets the projects whose root is another one than before and not empty: a
    project without files has the root ''. Only projects that a batch touches are folded again.

    Leaves and roots are logs in ``folder``: on a folder that has one, ``leaves`` isn't needed and isn't read. A batch that is repeated
    after a restart reports again what it reported before.
    """

    def __init__(self, leaves: DataFrame, on_changed: Callable[[DataFrame], None] | None = None, extensions=SCAN_EXTENSIONS, folder: str | None = None):
        spark, self.key = leaves.sparkSession, owner(leaves)
        folder = folder or f"{scratch_root(spark)}/loomdex-{uuid.uuid4().hex}/watch"
        kinds = {c: t for c, t in leaves.dtypes if c in self.key}
        named = ", ".join(f"{c} {t}" for c, t in kinds.items())
        path = [*self.key, "relative_path"]
        self.leaf_log = BatchLog(spark, f"{folder}/leaves", f"{named}, relative_path string, hash string", lambda rows: latest_by_key(rows, path, ["batch_id"]))
        self.root_log = BatchLog(spark, f"{folder}/roots", f"{named}, root string", lambda rows: latest_by_key(rows, self.key, ["batch_id"]))
        self.on_changed, self.extensions = on_changed, extensions
        if self.root_log.last() is None:
            self.leaf_log.append(-1, leaves.select(*path, "hash"))
            self.root_log.append(-1, merkle.roots(self.leaves).select(*self.key, "root"))

    @property
    def leaves(self) -> DataFrame:
        """Leaves of files that exist."""
        return self.leaf_log.rows().where("hash is not null").drop("batch_id")

    @property
    def roots(self) -> DataFrame:
        return self.root_log.rows().drop("batch_id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        taken = batch.where(has_extension(F.col("path"), self.extensions) & ~is_ignored(F.col("path")))
        last = latest_by_key(taken.select(*self.key, "path", "event_type", "content", "ts", "event_id"), [*self.key, "path"], ["ts", "event_id"])
        hashed = F.when(F.col("event_type") != "delete", file_hash(F.col("path"), F.col("content"))).alias("hash")
        last = materialize(last.select(*self.key, F.col("path").alias("relative_path"), hashed), "last")
        touched = last.select(*self.key).distinct()
        before = self.root_log.rows(before=batch_id).select(*self.key, F.col("root").alias("old"))
        self.leaf_log.append(batch_id, last)
        mine = self.leaves.join(touched, self.key, "left_semi")
        roots = touched.join(merkle.roots(mine).select(*self.key, "root"), self.key, "left").fillna("", ["root"])
        roots = materialize(roots, "roots")
        self.root_log.append(batch_id, roots)
        changed = roots.join(before, self.key, "left").where(~F.col("root").eqNullSafe(F.col("old")) & (F.col("root") != ""))
        if self.on_changed is not None and not changed.isEmpty():
            self.on_changed(changed.select(*self.key, "root"))


def _before(events: DataFrame) -> Column:
    """The type of the file's event before."""
    return F.lag("event_type").over(Window.partitionBy(*owner(events), "path").orderBy("ts", "event_id"))


def creations(events: DataFrame) -> DataFrame:
    """Events that make a file known: no delete, and the file's first event or the first one after a delete."""
    seen = events.withColumn("before", _before(events))
    return seen.where("event_type <> 'delete' and (before is null or before = 'delete')").drop("before")


def first_creations(events: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Events that are reported: a create or update of an untracked file as ``create``, other updates, deletes of tracked files."""
    seen = events.withColumn("before", _before(events))
    known = F.col("before").isNotNull() & (F.col("before") != "delete")
    if tracked is not None:
        seen = seen.join(tracked.select("project_id", "path").distinct().withColumn("t", F.lit(True)), ["project_id", "path"], "left")
        known = known | (F.col("before").isNull() & F.coalesce("t", F.lit(False)))
    kind = F.when((F.col("event_type") == "delete") & known, "delete").when(F.col("event_type") != "delete", F.when(known, "update").otherwise("create"))
    return seen.withColumn("reported", kind).where("reported is not null").select("project_id", "path", "reported", "ts", "event_id")
