"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset and the session runs on one machine, as in tests, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            drop_folder(spark, path)
        except Exception:  # the session may be gone; then its owner clears the folder
            pass

    atexit.register(drop)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
