"""Tables that cut lineage, in the folder that driver and executors share."""

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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    df._scratch = path, table
    return df


def kept_as(df: DataFrame, saved: DataFrame) -> DataFrame:
    """df, some columns of a saved table, such that drop deletes that table."""
    df._scratch = saved._scratch
    return df


def save(df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """Write df once (in folders by the value of a column) and return the written table: later reads survive the loss of any executor."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return _kept(df.sparkSession.read.schema(df.schema).parquet(path), path)


def save_bucketed(df: DataFrame, name: str, key: str, in_place: bool = False) -> DataFrame:
    """Write df in one bucket per shuffle partition, sorted by key: groupings and windows on key then need no shuffle.

    in_place: every task writes the buckets of its own rows, without a shuffle; for rows of which a task has few keys.
    """
    spark = df.sparkSession
    n, path = shuffle_partitions(spark), new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = (df if in_place else df.repartition(n, key)).write.option("compression", "zstd" if in_place else "snappy")
    writer.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    return _kept(spark.table(table), path, table)


def drop(df: DataFrame) -> None:
    """Delete a saved table that nothing reads any more; tables that save did not write stay."""
    path, table = getattr(df, "_scratch", (None, None))
    if path is None:
        return
    spark = df.sparkSession
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
