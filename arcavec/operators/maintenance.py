"""Upkeep as aggregates: what is due for an index, which segments to compact, sizes, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcavec.operators.quantize import code_bytes

FLUSH_ROWS, IDLE_ROWS, MERGE_RUNS, PATCH_BASE, PATCH_SHARE = 4096, 4096, 4, 4096, 16
LIVE_RATIO = 0.5
BUCKETS = 26


def due(c: dict[str, Column] | None = None) -> Column:
    """The one job an index needs next, by its counters delta, runs, run_rows, base, tombstones and idle; null if none."""
    c = c or {n: F.col(n) for n in ("delta", "runs", "run_rows", "base", "tombstones", "idle")}
    fold = (c["run_rows"] >= F.greatest(c["base"], F.lit(IDLE_ROWS))) | (c["idle"] & (c["delta"] + c["run_rows"] >= IDLE_ROWS))
    patch = (c["base"] >= PATCH_BASE) & (c["tombstones"] >= F.floor(c["base"] / PATCH_SHARE))
    return F.when(c["delta"] >= FLUSH_ROWS, "flush").when(fold, "consolidate").when(c["runs"] >= MERGE_RUNS, "runs-merge").when(patch, "delete-patch")


def compactable(records: DataFrame) -> DataFrame:
    """(segment, live, total) bytes of segments of which less than half is live; ``records`` has segment, bytes and alive."""
    sums = records.groupBy("segment").agg(F.sum(F.when(F.col("alive"), F.col("bytes")).otherwise(0)).alias("live"), F.sum("bytes").alias("total"))
    return sums.where(F.col("live") < LIVE_RATIO * F.col("total"))


def reclaim(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records after compaction, the bytes it frees by segment): live records of compactable segments move to a new one past the last, dead ones go."""
    dead = compactable(records)
    last = records.agg((F.max("segment") + 1).alias("_new"))
    marked = records.join(dead.select("segment", F.lit(True).alias("_gone")), "segment", "left").crossJoin(last)  # last is a single row
    stays = marked.where(F.col("_gone").isNull() | F.col("alive"))
    after = stays.withColumn("segment", F.when(F.col("_gone"), F.col("_new")).otherwise(F.col("segment"))).drop("_gone", "_new")
    return after, dead.select("segment", (F.col("total") - F.col("live")).alias("freed"))


def resident_bytes(vectors: DataFrame, kinds: tuple[str, ...] = ("f32", "int8", "binary", "tq1", "tq2", "tq4")) -> DataFrame:
    """(kind, rows, bytes) that codes of each kind take."""
    dims = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    sizes = vectors.sparkSession.createDataFrame([(r.dim, kind, code_bytes(kind, r.dim)) for r in dims.select("dim").collect() for kind in kinds] or [], "dim int, kind string, per_row long")
    return dims.join(F.broadcast(sizes), "dim").groupBy("kind").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("per_row")).alias("bytes"))


def evict(indexes: DataFrame, budget: int) -> DataFrame:
    """``indexes`` (shard, name, bytes, last_used) with resident: in each shard the most recently used ones whose bytes fit the budget together; the others are opened again when they are asked for."""
    order = Window.partitionBy("shard").orderBy(F.desc("last_used"), "name")
    return indexes.withColumn("resident", F.sum("bytes").over(order) <= budget)


def bucket_of(us: Column) -> Column:
    """The histogram bucket of a latency: 0 for 0, else its bit length, the last bucket taking all beyond."""
    bits = F.length(F.conv(us.cast("string"), 10, 2))
    return F.when(us <= 0, 0).otherwise(F.least(bits, F.lit(BUCKETS - 1))).cast("int")


def quantiles(latencies: DataFrame, shares: dict[str, float], by: str = "op", value: str = "us") -> DataFrame:
    """(by, n, one column for each share): the middle of the bucket in which the share is reached."""
    counts = latencies.groupBy(by, bucket_of(F.col(value)).alias("bucket")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(by).orderBy("bucket")  # at most BUCKETS rows of a group
    running = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    power = lambda e: F.pow(F.lit(2.0), e).cast("long")
    b = F.col("bucket")
    middle = F.when(b == 0, F.lit(0)).when(b == BUCKETS - 1, power(F.lit(BUCKETS - 2))).otherwise(F.floor((power(b - 1) + power(b)) / 2)).cast("long")
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.struct(b.alias("b"), middle.alias("m"))))["m"].alias(name) for name, q in shares.items()]
    return running.groupBy(by).agg(F.max("n").alias("n"), *picks)
