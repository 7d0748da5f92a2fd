"""Index tables as Parquet folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of many values; neighbours in the sorted files are much alike, so differences take less room than dictionaries.
_VARIED = ("doc_id", "term", "word", "gram", "pos", "positions.list.element")
_FORMAT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0",
           **{f"parquet.enable.dictionary#{name}": "false" for name in _VARIED}}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder path for a written table, under the shared folder of `spark.checkpoint.dir`.

    Where the session names none, a local session gets a temporary folder; on a cluster
    that is an error, since executors would not share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="prismdex-")
    return f"{shared.rstrip('/')}/prismdex-{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def write_table(df: DataFrame, path: str, sort_by: list[str] | None = None, files: int | None = None, add: bool = False) -> None:
    """Replace the table at `path`, or `add` rows to it. What was shuffled for it is dropped.

    With `sort_by` the rows are range partitioned and sorted on these columns, so that
    every file and row group covers a short range of them. Name enough columns that no
    single key is too large for one task: a range may end inside a key.
    """
    if sort_by:
        df = (df.repartitionByRange(files, *sort_by) if files else df.repartitionByRange(*sort_by))
        df = df.sortWithinPartitions(*sort_by)
    elif files:
        df = df.repartition(files)
    with _shuffles_dropped(df.sparkSession):
        df.write.mode("append" if add else "overwrite").options(**_FORMAT).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a written table, or a folder of them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def open_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table as it is now; opening again after a rebuild sees the new files."""
    spark.catalog.refreshByPath(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared workspace and read back: it is worked out once.

    Later stages, and stages run again after an executor is lost, read the files.
    """
    path = workspace(df.sparkSession, name)
    write_table(df, path)
    return open_table(df.sparkSession, path)


def open_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows of `schema` while it has not been built."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return open_table(spark, path, schema)
