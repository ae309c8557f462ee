"""Sessions with the settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans skewed joins and small partitions; ANSI mode turns counter overflow into an error.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session; dots in the names of ``more`` are written as two underscores."""
    builder = SparkSession.builder.appName("arcavec")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
