"""The folder that driver and executors share, and results kept there.

Lineage is cut only there, so a lost executor costs a recomputation and never a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, one in its warehouse, which is shared as well."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not have.isDefined():
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
        have = sc._jsc.sc().getCheckpointDir()
    return named or str(have.get())


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` now and keep it as a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system, whatever store that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def temporary(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there when the driver ends is deleted."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/linkforge-{uuid.uuid4().hex}"
    p, fs = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame) -> str:
    """Compute `df` now as Parquet in the shared folder; the files go when the driver ends, if nobody deletes them before."""
    path = temporary(df.sparkSession)
    df.write.mode("append").parquet(path)
    return path


def table(df: DataFrame) -> DataFrame:
    """`df`, written and read again: for rows that several plans need."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """`df`, written now in buckets by `key`, so that joins by it leave these rows where they are; and what drops it again."""
    spark, name = df.sparkSession, f"linkforge_{uuid.uuid4().hex}"
    path = temporary(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # a table with a path of its own leaves its files
        delete(spark, path)

    return spark.table(name), drop


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    fs.cancelDeleteOnExit(p)
    return fs.delete(p, True)
