"""Intermediate tables as Parquet in the folder that driver and executors share.

Nothing keeps state on an executor: a lost one costs a re-read.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    ``spark.checkpoint.dir`` decides. Where it is unset a local session (tests) gets a temporary
    folder; a cluster session is refused, because a machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexiquarry-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and return a reader of the written table.

    The folder is removed when the driver's JVM ends (Hadoop's delete-on-exit list).
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    # Nobody looks for a _SUCCESS file here; on local folders the driver launches two processes for each (chmod).
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:  # shuffle files go when the JVM sees that no plan refers to them
        tables[0].sparkSession.sparkContext._jvm.System.gc()
