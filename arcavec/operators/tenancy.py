"""Tenants: scoped names, quotas on vectors and bytes, command costs, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header bytes of a stored record, and the block that records are padded to.
HEADER, BLOCK = 21, 128

# Commands by their admission class.
KINDS = {
    "KvRead": ["GET", "MGET", "EXISTS"],
    "KvWrite": ["SET", "APPEND", "MSET", "DEL", "INCR", "DECR", "INCRBY", "DECRBY", "SUBJECT.ERASE"],
    "VectorRead": ["VSEARCH"],
    "VectorWrite": ["VSET", "VMSET", "VDEL"],
    "VindexCreate": ["VINDEX.CREATE"],
    "VindexDrop": ["VINDEX.DROP"],
    "VindexConsolidate": ["VINDEX.CONSOLIDATE"],
    "VindexList": ["VINDEX.LIST"],
    "Admin": ["TENANT.ERASE", "TENANT.DELETE", "RECLAIM", "QUOTA.SET", "QUOTA.GET", "QOS.SET", "QOS.GET"],
}
ERASE_COST, RECLAIM_COST = 100, 1000


def scoped(tenant: Column, name: Column) -> Column:
    return F.concat(tenant, F.lit("::"), name)


def unscoped(name: Column) -> Column:
    """The name without its tenant."""
    return F.regexp_replace(name, "^.*?::", "")


def resolve(*sources: Column) -> Column:
    """The tenant by the first source that knows one: login, request, connection; else the unscoped tenant."""
    return F.coalesce(*sources, F.lit(""))


def valid_name(name: str) -> bool:
    """1 to 255 letters, digits, dots, dashes and underscores, without two dots in a row."""
    return 0 < len(name) < 256 and all(c.isascii() and (c.isalnum() or c in "._-") for c in name) and ".." not in name


def top_per_tenant(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows (score) of each tenant; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def admit_vectors(writes: DataFrame, limits: DataFrame) -> DataFrame:
    """(tenant, admitted, rejected) distinct new ids against each tenant's limit, null for none; overwrites are free.

    First ids of a tenant are admitted in log order up to its limit, so the numbers need no order.
    """
    ids = writes.groupBy("tenant", "vec_id").agg(F.min("seq").alias("seq")).groupBy("tenant").agg(F.count("*").alias("n"))
    limited = ids.join(limits, "tenant", "left")
    admitted = F.when(F.col("max_vectors").isNull(), F.col("n")).otherwise(F.least("n", "max_vectors"))
    return limited.select("tenant", admitted.alias("admitted"), (F.col("n") - admitted).alias("rejected"))


def record_bytes(key: Column, value: Column) -> Column:
    """Stored bytes of a record: header, key and value, padded to blocks."""
    raw = F.lit(HEADER + BLOCK - 1) + F.octet_length(key) + F.octet_length(value)
    return (F.floor(raw / BLOCK) * BLOCK).cast("long")


def disk_use(records: DataFrame) -> DataFrame:
    """(tenant, bytes) of live records (tenant, key, value)."""
    return records.groupBy("tenant").agg(F.sum(record_bytes(F.col("key"), F.col("value"))).alias("bytes"))


def command_kind(op: Column) -> Column:
    out = None
    for kind, ops in KINDS.items():
        out = F.when(op.isin(ops), kind) if out is None else out.when(op.isin(ops), kind)
    return out.otherwise("Meta")


def command_cost(op: Column, k: Column, l_search: Column) -> Column:
    """A search costs its k and list size, an erasure and a reclaim flat sums, anything else 1."""
    return (
        F.when(op == "VSEARCH", F.greatest(F.lit(1), F.coalesce(k, F.lit(0)) + F.coalesce(l_search, F.lit(0))))
        .when(op.isin("SUBJECT.ERASE", "TENANT.ERASE", "TENANT.DELETE"), ERASE_COST).when(op == "RECLAIM", RECLAIM_COST).otherwise(1).cast("long")
    )


def erase_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows of all other tenants; the unscoped tenant can't be erased."""
    if not tenant:
        raise ValueError("the unscoped tenant can't be erased")
    return rows.where(F.col("tenant") != tenant)


class QuotaExceeded(ValueError):
    """A write that would take a tenant beyond its quota; nothing of it was written."""


def limit(text: str) -> int | None:
    """A limit as it is set: a number, or * for none."""
    if text == "*":
        return None
    if not (text.isascii() and text.isdigit()):
        raise ValueError("a limit is a non-negative integer or *")
    return int(text)


def shown(value: int | None) -> str:
    return "*" if value is None else str(value)


def admit_bytes(now: DataFrame, batch: DataFrame, limits: DataFrame) -> DataFrame:
    """(tenant, held, projected, max_bytes, admitted) of a batch of writes against live records, both (tenant, key, value), and limits (tenant, max_bytes), null or absent for none.

    What a write replaces is given back first; the last of equal keys of the batch, by its value,
    counts. A tenant's batch is admitted whole or not at all.
    """
    size = record_bytes(F.col("key"), F.col("value"))
    held = now.groupBy("tenant", "key").agg(F.max(size).alias("held"))
    new = batch.groupBy("tenant", "key").agg(F.max_by(size, F.col("value")).alias("new"))
    both = held.join(new, ["tenant", "key"], "full")
    sums = both.groupBy("tenant").agg(F.sum(F.coalesce("held", F.lit(0))).alias("held"), F.sum(F.coalesce("new", "held")).alias("projected"), F.count("new").alias("_writes"))
    sums = sums.where("_writes > 0").drop("_writes").join(limits, "tenant", "left")
    return sums.withColumn("admitted", F.coalesce(F.col("projected") <= F.col("max_bytes"), F.lit(True)))
