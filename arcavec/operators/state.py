"""State of append-only logs: newest wins, tombstones hide, resets start anew.

Newest-wins is an aggregation (max_by), so it combines before the shuffle and a hot key costs one
row a task; nothing is sorted but where order is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers of a bucket in which a key's rows are ordered by one task.
BUCKET = 1 << 16


def newest(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row of the greatest ``seq`` of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def whole_batches(log: DataFrame, batch: str = "batch_id", size: str = "batch_n") -> DataFrame:
    """Rows without a batch, and those of batches of which every member is there."""
    full = log.where(F.col(batch).isNotNull()).groupBy(batch).agg((F.count("*") >= F.max(size)).alias("_full")).where("_full").select(batch)
    return log.where(F.col(batch).isNull()).unionByName(log.join(full, batch, "left_semi").select(*log.columns))


def kv_state(log: DataFrame) -> DataFrame:
    """(key, seq, n) of keys whose newest SET or DEL is a SET."""
    return newest(log.where("op in ('SET', 'DEL')"), ["key"]).where("op = 'SET'").select("key", "seq", "n")


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def multi_get(requests: DataFrame, state: DataFrame) -> DataFrame:
    """(pos, key, n) for each request, null where the key is missing."""
    return requests.join(state.select("key", "n"), "key", "left").select("pos", "key", "n")


def exists(requests: DataFrame, state: DataFrame) -> DataFrame:
    """How many requests name a live key; a key that is asked for twice counts twice."""
    return requests.join(state, "key", "left_semi").agg(F.count("*").alias("found"))


def delete(requests: DataFrame, state: DataFrame) -> DataFrame:
    """How many keys a delete of the requests removes; each once."""
    return requests.join(state, "key", "left_semi").agg(F.count_distinct("key").alias("removed"))


def multi_set(pairs: DataFrame) -> DataFrame:
    """(key, value) after setting all pairs: of equal keys the last position wins."""
    return pairs.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def since_reset(log: DataFrame, resets: list[str]) -> DataFrame:
    """``log`` with reset: the newest reset of each key, null if none; rows before it are gone, resets stay. One aggregation and one join, so a hot key can be split."""
    last = log.where(F.col("op").isin(resets)).groupBy("key").agg(F.max("seq").alias("reset"))
    return log.join(last, "key", "left").where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))


def counters(log: DataFrame) -> DataFrame:
    """(key, value): the sum of a key's increments since its last SET, from the value set, or since its last DEL, from 0."""
    alive = since_reset(log, ["SET", "DEL"]).where("op in ('INCRBY', 'SET')")
    return alive.groupBy("key").agg(F.sum("n").alias("value"))


def _running(log: DataFrame, amount: Column, resets: list[str], bucket: int) -> DataFrame:
    """``log`` with value: the sum of a key's amounts up to each row since its last reset, whose own amount it starts with.

    A key's log is cut into buckets of sequence numbers. Rows are ordered within their bucket only;
    what a bucket starts with comes from one row for each earlier bucket, so a hot key is many tasks.
    """
    rows = log.withColumns({"_b": F.floor(F.col("seq") / bucket), "_amount": amount, "_reset": F.col("op").isin(resets).cast("long")})
    rows = rows.withColumn("_era", F.sum("_reset").over(Window.partitionBy("key", "_b").orderBy("seq")))
    rows = rows.withColumn("_local", F.sum("_amount").over(Window.partitionBy("key", "_b", "_era").orderBy("seq")))
    ends = rows.groupBy("key", "_b").agg((F.max("_era") > 0).alias("_has"), F.max_by("_local", "seq").alias("_tail"))
    by_bucket = Window.partitionBy("key").orderBy("_b")
    ends = ends.withColumn("_group", F.sum(F.col("_has").cast("long")).over(by_bucket))
    ends = ends.withColumn("_end", F.sum("_tail").over(Window.partitionBy("key", "_group").orderBy("_b")))
    carry = ends.select("key", "_b", F.coalesce(F.lag("_end").over(by_bucket), F.lit(0)).alias("_carry"))
    both = rows.join(carry, ["key", "_b"])
    return both.withColumn("value", F.col("_local") + F.when(F.col("_era") == 0, F.col("_carry")).otherwise(0))


def running_counter(log: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, seq, value): the reply to each increment, in log order within its key."""
    part = log.where("op in ('SET', 'DEL', 'INCRBY')")
    amount = F.when(F.col("op") == "DEL", 0).otherwise(F.col("n"))
    return _running(part, amount, ["SET", "DEL"], bucket).where("op = 'INCRBY'").select("key", "seq", "value")


def append_lengths(log: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, seq, length): the reply to each APPEND, the length of the text after it, in log order within its key since the last reset."""
    part = log.where("op in ('SET', 'DEL', 'APPEND')")
    size = F.when(F.col("op") == "DEL", 0).otherwise(F.length(F.col("n").cast("string")))
    return _running(part, size, ["SET", "DEL"], bucket).where("op = 'APPEND'").select("key", "seq", F.col("value").cast("long").alias("length"))


def appended(log: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, value): what a key holds after its APPENDs since its last SET or DEL, in log order; a SET starts the text. Texts of buckets of sequence numbers are joined first."""
    alive = since_reset(log, ["SET", "DEL"]).where("op in ('APPEND', 'SET')")
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("_t")))), lambda x: x["_t"]), "")
    parts = alive.groupBy("key", F.floor(F.col("seq") / bucket).alias("_b")).agg(joined("seq", F.col("n").cast("string")).alias("_part"))
    return parts.groupBy("key").agg(joined("_b", F.col("_part")).alias("value"))


def sweep_prefix(state: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(keys to erase, state without them)."""
    gone = F.col("key").startswith(prefix)
    return state.where(gone).select("key"), state.where(~gone)


def vector_state(log: DataFrame) -> DataFrame:
    """(vec_id, seq, embedding) of live vectors."""
    return newest(log, ["vec_id"]).where("op = 'I'").select("vec_id", "seq", "embedding")


def payload_state(log: DataFrame) -> DataFrame:
    """(vec_id, seq, payload): the newest payload since the vector's last delete; ``log`` has op P for a payload and D for a delete."""
    return newest(log.where("op in ('P', 'D')"), ["vec_id"]).where("op = 'P'").select("vec_id", "seq", "payload")


def consolidate(log: DataFrame) -> DataFrame:
    """The fold of all layers: live vectors in id order, ready to be written as the new base."""
    return vector_state(log).select("vec_id", "embedding").orderBy("vec_id")


def consolidate_from(base: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """A fold that began at ``upto`` joined with the writes since: a base of that time and the log's newer rows."""
    old = base.select("vec_id", F.lit(upto).cast("long").alias("seq"), F.lit("I").alias("op"), "embedding")
    return vector_state(old.unionByName(log.where(F.col("seq") > upto).select("vec_id", "seq", "op", "embedding")))


def delete_patch(base: DataFrame, dead: DataFrame) -> DataFrame:
    """Base rows that are neither dead nor shadowed."""
    return base.join(dead.select("vec_id").distinct(), "vec_id", "left_anti")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs of a log folded into one: the newest row of each id, tombstones included, because an older base may still hold the id."""
    return newest(runs, ["vec_id"])


def snapshot(log: DataFrame) -> DataFrame:
    """(key, seq, op, n): the newest SET or DEL of each key, with tombstones, as a point to resume from."""
    return newest(log.where("op in ('SET', 'DEL')"), ["key"]).select("key", "seq", "op", "n")


def resume(taken: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """The state of a log from a snapshot taken at ``upto`` and the rows since; only those are read of a log that is ordered by seq."""
    later = log.where((F.col("seq") > upto) & F.col("op").isin("SET", "DEL")).select("key", "seq", "op", "n")
    return kv_state(taken.unionByName(later))


def shard_of(key, shards: int):
    """The shard of a key; equal keys are always together. Numbers are this engine's own."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def routed(log: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """``log`` with its shard, dealt so that a shard's rows are in one partition, in log order."""
    return log.withColumn("shard", shard_of(F.col(key), shards)).repartition(shards, "shard").sortWithinPartitions("shard", "seq")
