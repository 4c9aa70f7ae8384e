"""Tables that cut lineage between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for a local session that names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder where it is unset in local mode. A cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return LOCAL_SCRATCH
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: later reads survive the loss of any executor, and its size is that of its files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; others stay."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of a written table's files."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
