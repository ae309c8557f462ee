"""Tables of a data folder, and the logs and payloads that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Sequence numbers of a later batch of the derived log are its number times this, plus the id: ids are below it.
BATCH = 10**12


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(embeddings: DataFrame) -> DataFrame:
    """(vec_id, payload): a token text for each vector but every eleventh, with a category, user, year, flag and two tags."""
    v = F.col("vec_id")
    year = F.when(v % 13 == 0, F.lit(" year=unknown")).otherwise(F.concat(F.lit(" year="), (2018 + v % 8).cast("string")))
    text = F.concat(
        F.lit("cat=c"), F.col("label").cast("string"), F.lit(" user=u"), (v % 50).cast("string"), year, F.when(v % 3 == 0, F.lit(" flag=1")).otherwise(""),
        F.lit(" tag=t"), (v % 3).cast("string"), F.lit(" tag=t"), (v % 5).cast("string"), F.lit(" loose"),
    )
    return embeddings.select("vec_id", F.when(v % 11 == 0, F.lit(None)).otherwise(text).alias("payload"))


def kv_log(events: DataFrame) -> DataFrame:
    """(seq, key, op, n): a log of writes, one for each event."""
    op = F.when(F.col("event_type") == "signup", "SET").when(F.col("event_type") == "click", "INCRBY").when(F.col("event_type") == "purchase", "APPEND").when(F.col("event_type") == "error", "DEL").otherwise("GET")
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), op.alias("op"), F.round("value").cast("long").alias("n"))


def vectors_log(embeddings: DataFrame) -> DataFrame:
    """(seq, op, vec_id, embedding): base versions, overwrites, deletes and vectors that come back; I inserts, D deletes."""
    v = F.col("vec_id")
    base = embeddings.select(v.alias("seq"), F.lit("I").alias("op"), "vec_id", "embedding")
    over = embeddings.where(v % 10 == 0).select((BATCH + v).alias("seq"), F.lit("I").alias("op"), "vec_id", F.reverse("embedding").alias("embedding"))
    gone = embeddings.where(v % 17 == 0).select((2 * BATCH + v).alias("seq"), F.lit("D").alias("op"), "vec_id", F.lit(None).cast(embeddings.schema["embedding"].dataType).alias("embedding"))
    back = embeddings.where(v % 34 == 0).select((3 * BATCH + v).alias("seq"), F.lit("I").alias("op"), "vec_id", "embedding")
    return base.unionByName(over).unionByName(gone).unionByName(back)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Writes a table; rows are ordered within files so that row-group minima and maxima act as a zone map."""
    out = df.sortWithinPartitions(*order) if order else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
