"""Trees of files as rows, and the projects' state tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.paths import SCAN_EXTENSIONS, has_extension, in_skipped_folder, is_ignored, language, to_relative
from loomdex.operators.tenants import file_key
from loomdex.runtime import materialize, ship


def scan(spark: SparkSession, root: str, project_id: str, extensions=SCAN_EXTENSIONS, ignore_globs: bool = False) -> DataFrame:
    """``(project_id, relative_path, content, language_id)`` of the files below ``root``.

    Paths are filtered before contents are read. A scan skips folders by name; with ``ignore_globs`` it
    takes a watcher's patterns instead. Bytes that aren't UTF-8 become replacement characters. Files that go while
    they are read, or can't be, are skipped.
    """
    ship(spark)
    gone = {"recursiveFileLookup": "true", "ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}
    listed = spark.read.format("binaryFile").options(**gone).load(root)
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    relative = to_relative(plain, "/" + base.split(":", 1)[1].lstrip("/"))
    found = listed.select("path", "content").withColumn("relative_path", relative)
    kept = ~is_ignored(F.col("relative_path")) if ignore_globs else ~in_skipped_folder(F.col("relative_path"))
    found = found.where(kept & has_extension(F.col("relative_path"), extensions))
    return found.select(
        F.lit(project_id).alias("project_id"), "relative_path", F.try_validate_utf8(F.decode("content", "UTF-8")).alias("content"), language(F.col("relative_path")).alias("language_id")
    )


def event_log(spark: SparkSession, path: str, schema: str = "project_id string, path string, event_type string, content string, ts timestamp, event_id long") -> DataFrame:
    """A folder of JSON event files as a stream; files must appear whole."""
    return spark.readStream.schema(schema).json(path)


def requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON request bodies with ``_corrupt`` set where one doesn't parse."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def save_version(state: DataFrame, path: str, version: int) -> None:
    """A snapshot of a state table, as a new version beside the older ones."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest snapshot that was written whole and can be read, or None where there is none.

    Versions are told by their folders' names; one without a mark of success, or whose files aren't what they should be, is passed over.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(fs_path(f"{path}/version=*/_SUCCESS"))
    found = {int(m.getPath().getParent().getName().split("=")[1]): str(m.getPath().getParent()) for m in marks or []}
    for version in sorted(found, reverse=True):
        try:
            state = spark.read.parquet(found[version])
            state.count()  # footers of all files
            return state
        except Exception as e:  # Spark's errors of a corrupt file have no common class
            warnings.warn(f"version {version} of {path} can't be read: {type(e).__name__}", stacklevel=2)
    return None


def content_cache(files: DataFrame) -> DataFrame:
    """``(..., relative_path, content)`` of ``files``, read once for all chunks that are read back from it."""
    return materialize(files.select(*file_key(files), "content"), "contents")


def without(cache: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The content cache after ``paths`` were dropped from it; all of it without any."""
    key = file_key(cache)
    return cache.limit(0) if paths is None else cache.join(paths.select(*key).distinct(), key, "left_anti")


def get_or_create_project(spark: SparkSession, path: str) -> DataFrame:
    """``(project_id, created_at)`` of a project folder: made once, read afterwards."""
    found = load_latest(spark, path)
    if found is None:
        made = spark.range(1).select(F.uuid().alias("project_id"), F.current_timestamp().alias("created_at"))
        save_version(made, path, 1)
        found = load_latest(spark, path)
    return found
