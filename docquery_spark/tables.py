"""Tables that stages write once and read back, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which all executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="docquery-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """A Parquet table at ``path``, or in the shared folder until the session's JVM ends, read back.

    Cuts the lineage: a lost executor neither runs a model again nor finds other rows.
    """
    spark, own = df.sparkSession, path is None
    path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if own:
        at, files = file_system(spark, path)
        files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
