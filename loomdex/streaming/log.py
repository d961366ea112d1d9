"""State of a foreachBatch sink as a log of batches in a shared folder, which outlives the driver.

Each micro-batch is one folder, written whole before its batch is committed by the stream; a batch that is repeated after a
restart replaces its own folder. What a sink knows is folded from the log, so a batch costs what it brings,
not what is known. Every COMPACT batches what precedes the newest is folded into a base, and what the base holds is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.runtime import ship

#: Batches after which the log is folded into a base.
COMPACT = 16


class BatchLog:
    """Rows by batch below ``path``; ``fold(rows)`` gives those that still count, of rows with a column ``batch_id``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame]):
        ship(spark)
        self.spark, self.path, self.schema, self.fold = spark, path, f"{schema}, batch_id long", fold

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind; what a crash left half written has no mark of success."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        marks = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-*/_SUCCESS"))
        return sorted(int(m.getPath().getParent().getName().partition("-")[2]) for m in marks or [])

    def last(self) -> int | None:
        """The last batch that was written, or None."""
        return max(self._folders("batch"), default=None)

    def append(self, batch_id: int, rows: DataFrame) -> None:
        """Write a batch, again if it is repeated."""
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        if len(self._folders("batch")) > COMPACT:
            self._compact(batch_id)

    def _compact(self, before: int) -> None:
        """Fold the batches that precede one, which itself may still be repeated."""
        self.rows(before).write.mode("overwrite").parquet(f"{self.path}/base-{before}")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind in ("batch", "base"):
            for n in self._folders(kind):
                if n < before:
                    fs.delete(fs_path(f"{self.path}/{kind}-{n}"), True)

    def rows(self, before: int | None = None) -> DataFrame:
        """What is known after all batches, or before one of them: of the newest base and the batches that aren't in it."""
        early = lambda n: before is None or n < before
        base = max((n for n in self._folders("base") if before is None or n <= before), default=None)
        parts = [f"{self.path}/batch-{n}" for n in self._folders("batch") if early(n) and (base is None or n >= base)]
        parts += [f"{self.path}/base-{base}"] * (base is not None)
        every = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return self.fold(every)
