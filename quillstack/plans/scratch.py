"""Tables that cut a lineage: written once to the folder all executors share, then read back.

A written table survives the loss of any executor. Its folder is the one the cluster names in
``spark.checkpoint.dir``; only on a local master, where all tasks share this machine, is one made if none is named.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session. Where none is named a local master makes one; any other is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.split("[")[0] != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        made = tempfile.mkdtemp(prefix="quillstack-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


#: Application and shared folder -> the folder of this session in it; folders made in open `scratch` blocks.
_OWN: dict[tuple[str, str], str] = {}
_BLOCKS: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder. What is there goes when the JVM ends, or before, with the `scratch` block it was made in."""
    key = spark.sparkContext.applicationId, shared_folder(spark)
    if key not in _OWN:
        _OWN[key] = f"{key[1]}/quillstack-{uuid.uuid4().hex}"
        fs, at = file_system(spark, _OWN[key])
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    path = f"{_OWN[key]}/{name}-{uuid.uuid4().hex}"
    for block in _BLOCKS:
        block.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes all tables written within the block when it ends, on whatever file system: use results inside.

    Gives the list of their paths, in order; one taken off it stays.
    """
    made: list[str] = []
    _BLOCKS.append(made)
    try:
        yield made
    finally:
        _BLOCKS[:] = [b for b in _BLOCKS if b is not made]
        for path in made:
            removed(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back. The shuffle files it took are removed at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table in ``folder``; the scan reads those alone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a scan has fewer parts than there are cores: small tables in one row group.

    A table of many files has more parts than that and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
