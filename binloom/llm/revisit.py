"""Resolution of WARC revisit records of the server-not-modified profile.

A 304 answer has no body; it stands for the latest earlier full response to the same canonical URL.  That
response is found by an as-of join over the captures of a URL, cut into stretches of time so that a URL
with very many captures is no single task; bodies never move, as only record ids, validators and headers
take part.  Validators are compared as RFC 9110 has it for conditional GETs, and headers merged as
RFC 9111, section 3.2, allows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header fields that a 304 never updates (RFC 9111, 3.2 and RFC 9110, 7.6.1).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Seconds of captures that one window goes over.
SEGMENT_SECONDS = 4096


def canonical_url(url: Column) -> Column:
    """Scheme, user, www., default port, fragment and last slash removed; host in lower case; query kept."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", "")
    return F.concat(F.regexp_replace(host, r":(?:80|443)?$", ""), F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), r"/$", ""))


def opaque(etag: Column) -> Column:
    """An entity tag without its weakness mark: conditional GETs compare tags weakly."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def resolve(captures: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """One row for each revisit of ``captures``: record_id, url_key, ts, source_id, status, payload_digest, headers.

    ``captures`` has record_id LONG, url, ts LONG (seconds), status_code INT, headers MAP of lower-case
    names, payload_digest; a row of status 304 is a revisit, one of 200 a full response, others are
    ignored.  status is "resolved", "mismatch" (the response has another validator), "unverified" (the two
    have no validator in common) or "missing" (no earlier full response).  source_id names the response
    that was found, whatever its validators; digest and merged headers are given when resolved, the
    revisit's own headers otherwise.

    A response at the very time of the revisit is not earlier; of several at one time the largest record_id
    counts.  Null urls share the key ""; a null ts is older than all others, so such a revisit finds
    nothing; null headers are no headers; repeated revisits are resolved each.  Empty tables give no rows.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = captures.filter("status_code IN (200, 304)").select(
        canonical_url(F.col("url")).alias("url_key"), "record_id", F.col("ts").cast("long").alias("ts"), (F.col("status_code") == 200).cast("int").alias("full"),
        F.coalesce(F.col("headers"), empty).alias("headers"), "payload_digest",
    )
    when = F.coalesce("ts", F.lit(-(2**62)))
    found = F.when(F.col("full") == 1, F.struct("record_id", "headers", "payload_digest"))
    rows = rows.withColumn("segment", F.floor(when / segment_seconds)).withColumn("r", found)
    order = [when.asc(), F.col("full").asc(), F.col("record_id").asc_nulls_first()]
    within = Window.partitionBy("url_key", "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("url_key").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(when.alias("t"), F.coalesce("record_id", F.lit(-(2**62))).alias("i"))
    ends = rows.groupBy("url_key", "segment").agg(F.max_by("r", F.when(F.col("full") == 1, at)).alias("end"))
    carried = ends.select("url_key", "segment", F.last("end", ignorenulls=True).over(along).alias("carried"))
    seen = rows.withColumn("inner", F.last("r", ignorenulls=True).over(within)).filter("full = 0")
    joined = seen.join(carried, ["url_key", "segment"]).withColumn("source", F.when(F.col("ts").isNotNull(), F.coalesce("inner", "carried")))
    tag, was_tag = opaque(F.col("headers")["etag"]), opaque(F.col("source.headers")["etag"])
    changed, was_changed = F.col("headers")["last-modified"], F.col("source.headers")["last-modified"]
    same = F.when(tag.isNotNull() & was_tag.isNotNull(), tag == was_tag).when(changed.isNotNull() & was_changed.isNotNull(), changed == was_changed)
    status = F.when(F.col("source").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_HEADERS))
    stored = F.map_filter("source.headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    resolved = F.col("status") == "resolved"
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "ts", F.col("source.record_id").alias("source_id"), "status",
        F.when(resolved, F.col("source.payload_digest")).alias("payload_digest"),
        F.when(resolved, F.map_concat(stored, fresh)).otherwise(F.col("headers")).alias("headers"),
    )


#: Fixed value: how the profile of server-not-modified revisits ends.
NOT_MODIFIED = "/server-not-modified"


def _fields(stream) -> dict[str, str]:
    """Named fields up to an empty line, names in lower case; lines that begin with white space go on, repeats are joined by commas."""
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return found


def warc_captures(stream) -> Iterator[tuple]:
    """(id, url, ts, status_code, headers, payload_digest) of the HTTP responses and not-modified revisits of a WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        head = _fields(stream)
        left = int(head.get("content-length", "0"))
        kind = head.get("warc-type", "")
        if kind == "response" or kind == "revisit" and head.get("warc-profile", "").endswith(NOT_MODIFIED):
            block = io.BytesIO(stream.read(left))
            left = 0
            status = block.readline().split(None, 2)
            if len(status) > 1 and status[0].startswith(b"HTTP/") and status[1].isdigit():
                ts = int(datetime.fromisoformat(head["warc-date"]).timestamp()) if "warc-date" in head else None
                yield head.get("warc-record-id", ""), head.get("warc-target-uri", "").strip("<>"), ts, int(status[1]), _fields(block), head.get("warc-payload-digest")
        while left > 0 and (skipped := stream.read(min(left, 1 << 20))):
            left -= len(skipped)


def _warc_rows(batches):
    for batch in batches:
        for content in batch.column("content"):
            raw = io.BytesIO(content.as_py())
            stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
            rows = list(warc_captures(stream))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string())
            made = [pa.array([list(h.items()) for h in c] if pa.types.is_map(k) else c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, ["id", "url", "ts", "status_code", "headers", "payload_digest"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures, as ``resolve`` takes them, of WARC files, packed or not; bodies are left out.

    record_id is a hash of the record's own.  A file is read whole by one task, so it may have 2 GB at most.
    """
    kinds = "id string, url string, ts long, status_code int, headers map<string,string>, payload_digest string"
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_warc_rows, kinds)
    return found.select(F.xxhash64("id").alias("record_id"), "url", "ts", "status_code", "headers", "payload_digest")


#: The captures made of a page: its own, and a later one that the server answered with 304.
REVISIT_AFTER = 5000


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages`` (page_id, url, html): a full response each, and a later revisit of the page.

    Page p is fetched at second 2 p and again 1 to some 10,000 seconds later.  Its entity tag is the digest
    of its html.  Every fifth revisit gives its tag weakly, every seventh only a date, every eleventh no
    validator at all.  Records of page p have the ids 2 p and 2 p + 1.
    """
    p, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    day = F.concat(F.lit("day "), (p % 28).cast("string"))
    first = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("x-cache"), F.lit("miss"),
    )
    none = F.create_map().cast("map<string,string>")
    tags = F.when((p % 7 == 0) | (p % 11 == 0), none).otherwise(F.create_map(F.lit("etag"), F.when(p % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)))
    dates = F.when(p % 11 == 0, none).otherwise(F.create_map(F.lit("last-modified"), day))
    second = F.map_concat(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("x-cache"), F.lit("hit"), F.lit("connection"), F.lit("close")), tags, dates)
    later = 2 * p + 1 + 2 * ((p * 7919) % REVISIT_AFTER)
    made = F.array(
        F.struct((2 * p).alias("record_id"), (2 * p).alias("ts"), F.lit(200).alias("status_code"), first.alias("headers"), digest.alias("payload_digest")),
        F.struct((2 * p + 1).alias("record_id"), later.alias("ts"), F.lit(304).alias("status_code"), second.alias("headers"), F.lit(None).cast("string").alias("payload_digest")),
    )
    return pages.select("url", F.explode(made).alias("m")).select("url", "m.*")
