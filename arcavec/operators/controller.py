"""Which of two proxies to search with, from sampled recalls of both.

Everything is windows over the samples of a key in order: moving averages, the proxy that the
averages ask for, how long it has been asked for without a break, and the mode, which is the last
one that was asked for ``PATIENCE`` times in a row. A state row carries a key on into later samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a new sample, tolerated loss, samples before a decision, equal decisions before a change, queries for each sample.
WEIGHT, TOLERANCE, WARMUP, PATIENCE, EVERY = 0.2, 0.01, 20, 3, 50
#: A sample so many places back has a weight of 1e-25.
MEMORY = 256
FAST, FULL = "hybrid", "asymmetric"
STATE = ("key", "n", "fast", "full", "wanted", "run", "mode")


def _average(x: Column, order) -> Column:
    recent = F.collect_list(x).over(order.rowsBetween(1 - MEMORY, 0))
    return F.aggregate(F.slice(recent, 2, MEMORY), recent[0], lambda a, v: a + F.lit(WEIGHT) * (v - a))


def controller_modes(samples: DataFrame, key: str = "key", seq: str = "seq", state: DataFrame | None = None) -> DataFrame:
    """(key, seq, n, fast, full, wanted, run, mode) after each sample (key, seq, fast, full): averages, the mode they ask for since ``run`` samples, null while warming up, and the mode in force."""
    rows = samples.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), "fast", "full")
    if state is not None:  # what was known stands before the first sample, as its averages
        rows = rows.unionByName(state.select("key", F.lit(None).cast("long").alias("seq"), "fast", "full"))
        known = state.select("key", F.col("n").alias("_n"), F.col("wanted").alias("_wanted"), F.col("run").alias("_run"), F.col("mode").alias("_mode"))
        rows = rows.join(known, "key", "left")
    else:
        rows = rows.withColumns({"_n": F.lit(None).cast("long"), "_wanted": F.lit(None).cast("string"), "_run": F.lit(None).cast("long"), "_mode": F.lit(None).cast("string")})
    order = Window.partitionBy("key").orderBy(F.col("seq").asc_nulls_first())
    rows = rows.select("key", "seq", "_wanted", "_run", "_mode", _average(F.col("fast"), order).alias("fast"), _average(F.col("full"), order).alias("full"), (F.row_number().over(order) + F.coalesce(F.col("_n") - 1, F.lit(0))).cast("long").alias("n"))
    asked = F.when(F.col("fast") >= F.col("full") - TOLERANCE, FAST).otherwise(FULL)
    rows = rows.withColumn("wanted", F.when(F.col("seq").isNull(), F.col("_wanted")).when(F.col("n") >= WARMUP, asked))
    before = F.lag("wanted").over(order)
    rows = rows.withColumn("_island", F.sum(F.when(F.col("wanted").eqNullSafe(before), 0).otherwise(1)).over(order))
    in_run = Window.partitionBy("key", "_island").orderBy(F.col("seq").asc_nulls_first())
    carried = F.first(F.when(F.col("seq").isNull(), F.col("_run") - 1)).over(in_run)
    rows = rows.withColumn("run", (F.row_number().over(in_run) + F.coalesce(carried, F.lit(0))).cast("long"))
    settled = F.when(F.col("wanted").isNotNull() & (F.col("run") >= PATIENCE), F.col("wanted"))
    mode = F.coalesce(F.last(settled, ignorenulls=True).over(order), F.col("_mode"), F.lit(FAST))
    return rows.withColumn("mode", mode).where("seq is not null").select("key", "seq", "n", "fast", "full", "wanted", "run", "mode")


def controller_state(modes: DataFrame) -> DataFrame:
    """One row for each key, to be kept and given to ``controller_modes`` with later samples."""
    rest = [c for c in STATE if c != "key"]
    return modes.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_s")).select("key", "_s.*")
