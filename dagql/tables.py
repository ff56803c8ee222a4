"""Tables that a job writes for itself: lineage is cut at them, and what several readers need is computed once."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, kind: str = "parquet") -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.{kind}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a folder of this machine, but only
    for a session that runs on this machine alone."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dagql-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it back: lost executors cost no recomputation, rows are
    packed and read by columns, and the planner's sizes start from the files. The table stays until it is forgotten."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.dagql_table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.dagql_table)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted: executors keep them until the driver, whose heap hardly fills, collects
    its garbage. What Arrow holds unused goes back too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
