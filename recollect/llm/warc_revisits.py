"""Resolution of not-modified revisit records of web archives.

A revisit with the not-modified profile has headers but no body. It is resolved by an as-of join: among the full
responses with its canonical URL, the latest that was captured before it. Their validators are then compared (entity
tags weakly, or the modification dates if either lacks a tag), and the stored headers are updated by those that a
not-modified response may change.

The join sorts records by URL, time and id in ranges, so that a URL with very many captures is spread over partitions;
each partition passes over its rows once, remembering the last response, and what a partition's first URL inherits from
earlier partitions comes from a table with one row for each partition.

Rows: a record whose URL or date is null matches nothing; responses with one date are ordered by id, and a revisit sees
those of its own date with a smaller id; repeated ids are records of their own in the join, and a repeated response id
gives each of its bodies; header names are compared without case, of repeated names the last counts, null headers are
none. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, checkpoint

# Header fields that a not-modified response does not change.
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
# Fixed value: query parameters that do not tell pages apart.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|msclkid|ref|sessionid|phpsessid|jsessionid)(=|$)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host without user, www and default port, path without closing slash, and the sorted query without tracking."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, f"{SCHEME}(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(u, f"{SCHEME}[^/?#]*([^?#]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(host == "", u).otherwise(F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def lower_headers(headers: Column) -> Column:
    """Entries with lower-case names; of repeated names the last."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))


def _value(entries: str, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def _tag(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^W/", "")


def as_of(records: DataFrame, key: str, time: str, row_id: str, is_source: str) -> DataFrame:
    """id and source of each row that is no source: the latest source of its key before it, by time and id."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(row_id).alias("id"), F.col(is_source).alias("is_source"))
    ordered = rows.repartitionByRange(n, "key", "time", "id").sortWithinPartitions("key", "time", "id").select("key", "id", "is_source")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key_now, source, first = TaskContext.get().partitionId(), None, None, None
        names, kinds = ["part", "id", "source", "key", "is_tail"], (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for keys, ids, sources in batches(parts, "key", "id", "is_source"):
            out = []
            for k, i, s in zip(keys, ids, sources, strict=True):
                if first is None:
                    first = k
                if k != key_now:
                    key_now, source = k, None
                if s:
                    source = i
                else:
                    out.append((number, i, source, k if source is None and k == first else None, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if key_now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, None, source, key_now, True), kinds, strict=True)], names=names)

    found = checkpoint(ordered.mapInArrow(run, "part int, id long, source long, key string, is_tail boolean"))
    # One row for each partition: its last key and that key's last source there.
    tails = found.filter("is_tail").select("part", "key", "source").repartition(1)
    carried = tails.withColumn("carried", F.last("source", ignorenulls=True).over(Window.partitionBy("key").orderBy("part"))).select(F.col("part").alias("tail"), "key", "carried")
    carried = carried.withColumn("until", F.lead("tail").over(Window.partitionBy("key").orderBy("tail")))
    told = found.filter("NOT is_tail").withColumnRenamed("key", "k")
    joined = told.join(F.broadcast(carried), F.expr("k = key AND tail < part AND (until IS NULL OR until >= part)"), "left")
    return joined.select("id", F.coalesce("source", "carried").alias("source"))


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, outcome, response_id, headers (merged, with lower-case names), payload.

    Reads record_id, warc_type, target_uri, warc_date, headers and payload. Outcome is `resolved`, `changed` (validators
    differ; headers and payload are then null), `unvalidated` (no validator in common; likewise) or `no earlier response`.
    """
    rows = records.select("record_id", "warc_type", canonical_url(F.col("target_uri")).alias("canonical_url"), "warc_date", lower_headers(F.col("headers")).alias("h"), "payload")
    slim = rows.filter(F.col("warc_type").isin("response", "revisit")).select("record_id", "canonical_url", "warc_date", (F.col("warc_type") == "response").alias("full"))
    pairs = as_of(slim, "canonical_url", "warc_date", "record_id", "full").filter("source IS NOT NULL").select(F.col("id").alias("record_id"), F.col("source").alias("response_id")).distinct()
    revisits = rows.filter("warc_type = 'revisit'").select("record_id", "canonical_url", F.col("h").alias("new"))
    responses = rows.filter("warc_type = 'response'").select(F.col("record_id").alias("response_id"), F.col("h").alias("old"), "payload")
    both = revisits.join(pairs, "record_id", "left").join(responses, "response_id", "left")
    tags, dates = (_tag(_value("new", "etag")), _tag(_value("old", "etag"))), (F.trim(_value("new", "last-modified")), F.trim(_value("old", "last-modified")))
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    outcome = F.when(F.col("response_id").isNull(), "no earlier response").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("changed")
    permitted = F.filter("new", lambda e: ~e["key"].isin(KEPT_HEADERS))
    merged = F.map_from_entries(F.concat(F.filter("old", lambda e: ~F.exists(permitted, lambda x: x["key"] == e["key"])), permitted))
    done = outcome == "resolved"
    return both.select("record_id", "canonical_url", outcome.alias("outcome"), "response_id", F.when(done, merged).alias("headers"), F.when(done, F.col("payload")).alias("payload"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl history of pages: each page is fetched in full once and asked for again twice, with a not-modified answer.

    Record 3 p is page p's response, fetched p seconds into the crawl. Record 3 p + 1, later, repeats its entity tag
    weakly under http and with a tracking parameter, where the URL has no query or fragment. Record 3 p + 2 has, by p
    modulo 3, another tag; the modification date only; or the tag, but an earlier date than the response. Pages without
    an id or URL are left out.
    """
    page = pages.filter("page_id IS NOT NULL AND url IS NOT NULL").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("tag", F.md5("html")).withColumn("changed", F.concat(F.lit("day "), F.col("page_id") % 1000))
    again = F.when(~F.col("url").rlike("[?#]"), F.concat(F.regexp_replace("url", "^https", "http"), F.lit("?utm_source=again"))).otherwise(F.col("url"))

    def pairs(*values: str | Column) -> Column:
        return F.create_map(*(F.lit(v) if isinstance(v, str) else v for v in values))

    etag, weak = F.concat(F.lit('"'), "tag", F.lit('"')), F.concat(F.lit('W/"'), "tag", F.lit('"'))
    response = page.select((F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.col("page_id").alias("warc_date"), pairs("ETag", etag, "Last-Modified", F.col("changed"), "Content-Type", "text/html", "Content-Length", F.length("html").cast("string"), "Cache-Control", "max-age=60").alias("headers"), F.col("html").alias("payload"))
    first = page.select((F.col("page_id") * 3 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), again.alias("target_uri"), (F.col("page_id") + 10**9).alias("warc_date"), pairs("etag", weak, "cache-control", F.concat(F.lit("max-age="), F.col("page_id") % 100), "Content-Length", "0", "X-Cache", "hit").alias("headers"), F.lit(None).cast("string").alias("payload"))
    kind = F.col("page_id") % 3
    headers = F.when(kind == 0, pairs("ETag", '"another"')).when(kind == 1, pairs("Last-Modified", F.col("changed"))).otherwise(pairs("ETag", etag))
    second = page.select((F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"), F.when(kind == 2, -1 - F.col("page_id")).otherwise(F.col("page_id") + 2 * 10**9).alias("warc_date"), headers.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(first).unionByName(second)
