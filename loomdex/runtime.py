"""Session helpers: shared scratch tables that cut lineage and survive lost executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest serialized side, in bytes, that an operator of this library may broadcast by hint.
BROADCAST_LIMIT_BYTES = 16 << 20


_shipped: set[str] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the application's Python workers, once: they may have no copy installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="loomdex-ship-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset, as in local tests, a temporary folder is made and
    set as the session's checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomdex-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Unlike a cache, the result has no lineage to recompute and doesn't depend
    on any single executor.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_root(spark)}/loomdex-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomdex_path = path  # so that discard() finds it
    _written.append(path)
    return out


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """About how many partitions of so many bytes as stored a table of files makes, 8 to 100,000; of others, by the session's cores."""
    spark = df.sparkSession
    if not df.inputFiles():
        return max(8, spark.sparkContext.defaultParallelism)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(100_000, max(8, -(-size // bytes_each)))


def bucketed(df: DataFrame, key: str, n: int, name: str = "table", then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """As :func:`materialize`, in ``n`` buckets by ``key``: rows are shuffled here once, and joins on the key shuffle the other side only.

    ``then`` adds columns to the rows after they were shuffled.
    """
    spark = df.sparkSession
    ship(spark)
    path, table = f"{scratch_root(spark)}/loomdex-{uuid.uuid4().hex}/{name}", f"loomdex_{name}_{uuid.uuid4().hex}"
    shuffled = then(df.repartition(n, key))
    shuffled.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out._loomdex_path = path
    _written.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_loomdex_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target.getParent(), True)


def written() -> int:
    """How many scratch tables this process wrote that weren't deleted by :func:`clear_scratch`."""
    return len(_written)


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables that this process wrote, all or those after the first ``since``: for when no result that reads one is needed."""
    while len(_written) > since:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target.getParent(), True)


def bytes_of(df: DataFrame, *columns: str) -> int:
    """Total bytes of string or binary ``columns``: a check before a broadcast."""
    from pyspark.sql import functions as F

    parts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns]
    return int(df.agg(sum(parts[1:], parts[0]).alias("n")).first()["n"])
