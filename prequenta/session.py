"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for one intermediate table, below the folder the cluster names.

    The folder is read from ``spark.checkpoint.dir``, or else it lies below the session's
    warehouse. Both are reachable for every executor, so the rule is the same on any master.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get(WAREHOUSE_DIR).rstrip('/')}/intermediate"
    return f"{base.rstrip('/')}/prequenta/{purpose}-{uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that ``shared_folder`` named."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    return [entry.getPath().getName() for entry in fs.listStatus(hadoop_path)]


def create_marker(spark: SparkSession, path: str) -> None:
    """Create an empty file; an error if there is one already."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(hadoop_path, False).close()
