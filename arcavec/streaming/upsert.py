"""Ingest as a stream: micro-batches append to a log, and the newest row of each key is the state.

Late rows need no watermark: the order is that of the log's sequence numbers, not of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcavec.operators import state


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet log, exactly once by the sink's own commit log."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """Live vectors of a log that a stream appends to."""
    return state.vector_state(spark.read.parquet(path))


def compact(spark: SparkSession, log: str, base: str, upto: int) -> None:
    """Writes the state as of ``upto`` in id order; later readers take the base and the log's newer rows."""
    rows = spark.read.parquet(log).where(F.col("seq") <= upto)
    state.consolidate(rows).write.mode("overwrite").parquet(base)
