"""Shared-folder helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for intermediate data.

    Read from the session. Only a local-mode session that names none gets a
    folder of its own; a cluster must name one every executor can reach.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="netquarry-")
    spark.conf.set(_SETTING, own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once and read it back, cutting its lineage.

    The table outlives executors, keeps column pruning and carries file sizes,
    so later joins can choose a broadcast by a real size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    files, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _file_system(spark, path)
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not exist yet; a second writer of it fails."""
    files, target = _file_system(spark, path)
    stream = files.create(target, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
