"""WARC revisits: each not-modified record finds the full response that it stands for.

An as-of join by canonical URL: the latest full response before the revisit, by (time, record id).
If the revisit names an ETag it must equal the response's, else if it names a Last-Modified that
must; a revisit without either is taken by its URL. Headers of the response are then updated by
those of the revisit, except fields that describe the stored body or a single connection.

The join is native and splits hot URLs: time is cut into ``SLICES`` slices of about as many records
each, wherever a few times lie far from all others, the last response of each (URL, slice) is carried into later slices by one small window, and the as-of
windows run within (URL, slice).

Defined cases: a revisit without URL, without an earlier response or with another validator comes out
unresolved and says why; a null time or id leaves a response out, and a revisit unresolved; null
headers are no headers; of headers that differ in case only one stays; repeated rows give rows each;
of responses at one time the greatest id is the latest; values may be very long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256

#: Fields that a 304 doesn't update: connection fields and those that describe the stored content.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Host in small letters without www. and default port, path without a last slash, query in order without utm_ fields; no scheme, no fragment."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields, updated by the permitted ones of the 304, as an ordered array of name: value; names in small letters."""
    none = F.create_map().cast("map<string,string>")
    small = lambda m: F.map_from_entries(F.aggregate(  # noqa: E731  the last of names that are equal in small letters stays
        F.array_sort(F.map_entries(F.coalesce(m, none))), F.array().cast("array<struct<key:string,value:string>>"),
        lambda done, e: F.concat(F.filter(done, lambda d: d["key"] != F.lower(e["key"])), F.array(F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))
    allowed = F.map_filter(small(update), lambda k, _: ~k.isin(KEPT_FIELDS))
    base = F.map_filter(small(stored), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.array_sort(F.transform(F.map_entries(F.map_concat(base, allowed)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """For each row with record_type revisit: record_id, canonical_url, response_id, outcome, headers and payload_digest.

    ``records`` has record_id, record_type (response or revisit), url, ts (a number), etag,
    last_modified, headers map<string,string> and payload_digest; response_id, headers and
    payload_digest are null unless outcome is resolved.
    """
    shares = [k / slices for k in range(1, slices)] or [0.0]
    spread = records.agg(F.percentile_approx(F.col("ts").cast("double"), shares).alias("_bounds"))
    rows = records.select("record_id", "record_type", canonical_url(F.col("url")).alias("u"), F.col("ts").cast("double").alias("ts"), "etag", "last_modified", "headers", "payload_digest")
    rows = rows.where("record_type in ('response', 'revisit')").crossJoin(F.broadcast(spread))  # one row
    rows = rows.withColumn("slice", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("ts"))), F.lit(0))).drop("_bounds")
    full = F.when((F.col("record_type") == "response") & F.col("record_id").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "headers", "payload_digest"))
    rows = rows.withColumn("full", full)
    usable = rows.where("u is not null")
    last = usable.where("full is not null").groupBy("u", "slice").agg(F.max_by("full", F.struct("full.ts", "full.record_id")).alias("latest"))
    # slices that hold revisits take the latest response of any earlier slice
    wanted = usable.where("record_type = 'revisit'").select("u", "slice").distinct().withColumn("latest", F.lit(None).cast(last.schema["latest"].dataType)).withColumn("want", F.lit(1))
    by_slice = Window.partitionBy("u").orderBy("slice", "want").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = last.withColumn("want", F.lit(2)).unionByName(wanted).withColumn("carry", F.last("latest", ignorenulls=True).over(by_slice)).where("want = 1").select("u", "slice", "carry")
    in_slice = Window.partitionBy("u", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = usable.where("full is not null or record_type = 'revisit'").withColumn("near", F.last("full", ignorenulls=True).over(in_slice)).where("record_type = 'revisit'")
    joined = near.join(carried, ["u", "slice"], "left").withColumn("r", F.coalesce("near", "carry"))
    lost = rows.where("u is null and record_type = 'revisit'").withColumn("r", full)
    both = joined.select("record_id", "u", "ts", "etag", "last_modified", "headers", "r").unionByName(lost.select("record_id", "u", "ts", "etag", "last_modified", "headers", "r"))
    outcome = (
        F.when(F.col("u").isNull(), "no url").when(F.col("ts").isNull() | F.col("record_id").isNull() | F.col("r").isNull(), "no earlier response")
        .when(F.col("etag").isNotNull() & ~F.col("etag").eqNullSafe(F.col("r.etag")), "validator differs")
        .when(F.col("etag").isNull() & F.col("last_modified").isNotNull() & ~F.col("last_modified").eqNullSafe(F.col("r.last_modified")), "validator differs")
        .otherwise("resolved")
    )
    both = both.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return both.select(
        "record_id", F.col("u").alias("canonical_url"), F.when(ok, F.col("r.record_id")).alias("response_id"), "outcome",
        F.when(ok, merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"), F.when(ok, F.col("r.payload_digest")).alias("payload_digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawl records of the pages table: each page as a full response, and later a revisit of its URL in another spelling."""
    p = F.col("page_id").cast("long")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    page = pages.select(p.alias("p"), "url", etag.alias("tag"), F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    p = F.col("p")
    modified = F.concat(F.lit("day "), (p % 97).cast("string"))
    time1, time2 = p * 10, p * 10 + 5 + (p % 5) * 1000
    response = page.select(
        (2 * p).alias("record_id"), F.lit("response").alias("record_type"), "url", time1.alias("ts"), F.col("tag").alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("Date"), time1.cast("string"), F.lit("Server"), F.lit("first")).alias("headers"), "payload_digest",
    )
    revisit = page.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("record_type"),
        F.when(p % 3 == 0, F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.when(F.col("url").contains("#"), F.lit("")).otherwise("#top"))).otherwise(F.col("url")).alias("url"), time2.alias("ts"),
        F.when(p % 7 == 0, F.lit(None)).when(p % 7 == 1, F.lit('"other"')).otherwise(F.col("tag")).alias("etag"), F.when(p % 14 == 0, modified).when(p % 7 == 0, F.lit("day x")).alias("last_modified"),
        F.create_map(F.lit("date"), time2.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("SERVER"), F.lit("second")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return response.unionByName(revisit)
