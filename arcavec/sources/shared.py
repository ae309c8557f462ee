"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset as in tests, a folder of this machine that becomes it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arcavec-"))
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark)}/arcavec/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` computed now and read from the shared folder."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
