"""What the operators of this subpackage share: tables, scratch storage and settings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where scratch tables go when the session is local and names no checkpoint folder (tests, a laptop).
LOCAL_SCRATCH = "/tmp/quarrystone-scratch"

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: For bytes.translate: A-Z lower-cased, all else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Hands Python workers small Arrow batches: texts and packed tiles can be large, and a batch is held whole. All operators here use the same setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session that has none gets a local one; a cluster must name one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or LOCAL_SCRATCH).rstrip('/')}/quarrystone/{sc.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    jvm = spark.sparkContext._jvm
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def hold(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors, is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator wants for itself."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with more columns at its end, by name and type."""
    more = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])
