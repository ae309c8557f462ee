"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arcavec.sources import shared
from arcavec.sources.shared import folder


class Table:
    """A DataFrame written as Parquet, so that it is computed once and survives lost executors. ``release`` is for writes that shuffled much."""

    def __init__(self, df: DataFrame, buckets: int = 0, by: tuple[str, ...] = (), release: bool = True):
        self.spark, self.name = df.sparkSession, f"arcavec_{uuid.uuid4().hex}"
        self.path = f"{folder(self.spark)}/arcavec/{self.name}"
        if buckets:
            df.write.bucketBy(buckets, *by).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
            self.df = self.spark.table(self.name)
        else:
            df.write.option("compression", "zstd").parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)
            self.name = ""
        # what only this write needed is garbage now; a collection lets Spark's cleaner drop its shuffle files before the next step
        if release:
            self.spark._jvm.System.gc()

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        shared.delete(self.spark, self.path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
