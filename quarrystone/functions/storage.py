"""Results kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local session that has none gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or f"/tmp/quarrystone-checkpoints/{sc.applicationId}").rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return where.toString()


def kept(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint: computed once, its lineage cut, read again if an executor is lost.

    Checkpoints lie in the shared folder; Spark removes those that nothing refers to any longer where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str = "round") -> DataFrame:
    """df by way of a written table in the shared folder: what rounds need that join a table with itself.

    A checkpoint passes its plan's estimated size on, and a join's estimate is the product of its sides', so over such rounds the estimate gains
    twice the digits each time, until planning alone takes minutes and no side is ever small enough to broadcast. A table has the size of its files.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
