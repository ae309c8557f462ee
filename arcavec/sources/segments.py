"""A log as segment files of checked records, one a line: the CRC of the record, then the record.

A segment is read up to its first corrupt record, as what follows that can't be trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("seq", "key", "op", "n")


def record(seq: Column, key: Column, op: Column, n: Column) -> Column:
    return F.to_json(F.struct(seq.alias("seq"), key.alias("key"), op.alias("op"), n.alias("n")))


def write_segments(log: DataFrame, path: str, segment: Column, damaged: Column | None = None) -> None:
    """Writes (seq, key, op, n) in order of seq, a file for each segment; rows that ``damaged`` marks get a wrong CRC, for tests."""
    body = record(*(F.col(c) for c in COLUMNS))
    crc = F.crc32(body.cast("binary"))
    crc = crc if damaged is None else F.when(damaged, crc + 1).otherwise(crc)
    rows = log.select(segment.cast("long").alias("segment"), "seq", F.concat_ws(" ", crc.cast("string"), body).alias("value"))
    rows.repartition("segment").sortWithinPartitions("segment", "seq").select("segment", "value").write.mode("overwrite").partitionBy("segment").text(path)


def list_segments(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the segments in a folder, ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = (f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("segment=") and n[8:].isdigit())


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, pos, seq, key, op, n) of the records before the first corrupt one of each segment. A segment is one row while it is parsed, so its size is bounded by that of a file."""
    files = spark.read.schema("value string, segment long").text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.struct(F.substring_index(x, " ", 1).alias("crc"), x.substr(F.instr(x, " ") + 1, F.length(x)).alias("body")))
    good = F.transform(parts, lambda x: x["crc"] == F.crc32(x["body"].cast("binary")).cast("string"))
    upto = F.coalesce(F.nullif(F.array_position(good, False), F.lit(0)) - 1, F.size(good))
    whole = files.select("segment", F.posexplode(F.slice(parts, F.lit(1), upto.cast("int"))).alias("pos", "r"))
    return whole.select("segment", F.col("pos").cast("long").alias("pos"), F.from_json("r.body", "seq long, key string, op string, n long").alias("v")).select("segment", "pos", "v.*")
