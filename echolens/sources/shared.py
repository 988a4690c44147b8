"""Folder for written intermediate tables and streaming state, and how tasks open files."""

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    A session on this machine alone (``local[n]``) that names none gets a temporary folder, the same for
    the whole session; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            base = tempfile.mkdtemp(prefix="echolens-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/echolens/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and continue from the file: cuts lineage, and later
    passes read only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(path: str):
    """Arrow's file system and its name of a path as Spark spells it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
