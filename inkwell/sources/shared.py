"""Where written intermediate tables go.

A cluster names a folder that every executor can reach in ``spark.checkpoint.dir``.  Everything that cuts lineage or
is read again goes there, so a lost executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.  Only in local mode (tests, a laptop), where none is set, one is made under the temp dir; on a cluster that is an error, as executors couldn't reach it."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        named = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls get the same one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder until nothing refers to it any more: for narrow tables that are read more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here.  The table goes when the driver ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path object) of a path, by way of the JVM: works for any scheme that Spark can read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def until_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove ``path``, which is there already, when the driver's JVM ends: whatever reads it lazily can until then."""
    fs, where = hadoop_fs(spark, path)
    fs.deleteOnExit(where)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_fs(spark, path)
    return fs.exists(where)


def content_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files within ``path``."""
    fs, where = hadoop_fs(spark, path)
    return fs.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_fs(spark, path)
    fs.delete(where, True)
