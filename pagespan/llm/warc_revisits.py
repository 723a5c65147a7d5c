"""WARC: not-modified revisits resolved to the latest earlier full response.

A capture log has one row per record: record_id, url, kind ('response' or
'revisit'), ts (seconds), headers (map of lower-case names). URLs are compared in
canonical form: no scheme, host in lower case without its scheme's default port, no
fragment, no closing slash, query parameters sorted and without tracking ones.
The scheme may be missing (`//host/path`, or `host/path` where the host has a dot);
what has no host is no URL and has no canonical form.
A revisit takes the response of its URL with the largest ts before its own (of
equal ones the largest record_id), if the validators agree: entity tags, compared
weakly, where both have one; else Last-Modified where both have one. Headers of
the revisit replace stored ones, but for hop-by-hop fields, the fields that its
Connection names, and those that describe the stored body.

The as-of join is pre-aggregated and two-level: one row per URL and second, the
latest response before it within (URL, time bucket), then over one summary row per
URL and bucket. A URL with any share of the rows has at most as many rows in a
task as a bucket has seconds, or as the log has buckets.

From files: read_warc() gives records, captures_of_records() their capture log, in which only server-not-modified revisits
are `revisit`; a revisit of profile identical-payload-digest is a full answer whose body was seen before, and
resolve_identical() finds the record that has it: the one that it names, else the latest earlier response with that digest,
under any URL. Record ids of files are 64-bit hashes of their WARC-Record-ID.

Defined results: null ts, or null or other url without canonical form: outcome
'no-response'; null headers are empty; kinds other than the two are left out; a
response without record_id can't be referred to and is left out, a revisit without
one is resolved like any other; records that repeat are resolved each; of
responses that share record_id, URL and ts the one whose headers come first as
text counts; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields that a 304 answer doesn't update (HTTP caching, and hop-by-hop fields).
NOT_UPDATED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type")
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


_SCHEME = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//"
_BARE_HOST = "^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+(:[0-9]+)?$"


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(url, "#.*$", "")
    marked = bare.rlike(_SCHEME)
    scheme = F.lower(F.regexp_extract(bare, _SCHEME, 1))
    rest = F.regexp_replace(bare, _SCHEME, "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise("(?!)")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    whole = F.concat(F.regexp_replace(host, port, F.lit("")), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.when(marked, host.rlike("^[^:]")).otherwise(host.rlike(_BARE_HOST)), whole)


def latest_before(rows: DataFrame, bucket_seconds: int) -> DataFrame:
    """rows (key, ts, record_id, full) -> key, ts (each once), found (ts, record_id of the latest full row of the key before ts)."""
    at = rows.groupBy("key", "ts").agg(F.max(F.when(F.col("full"), F.col("record_id"))).alias("record_id")).withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    mark = F.when(F.col("record_id").isNotNull(), F.struct("ts", "record_id"))
    near = F.max(mark).over(Window.partitionBy("key", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("near", near).withColumn("own", mark)
    top = at.groupBy("key", "bucket").agg(F.max("own").alias("top"))
    far = top.select("key", "bucket", F.max("top").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    return at.join(far, ["key", "bucket"]).select("key", "ts", F.coalesce("near", "far").alias("found"))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """record_id, canonical, response_id, outcome, headers (map; null unless resolved) for every revisit."""
    c = captures.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("key"), "kind", F.col("ts").cast("long").alias("ts"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    ).where("kind in ('response', 'revisit')")
    full = F.col("kind") == "response"
    keys = c.where("key is not null and ts is not null and (record_id is not null or kind = 'revisit')").select("key", "ts", "record_id", full.alias("full"))
    found = latest_before(keys, bucket_seconds).where("found is not null").select("key", "ts", F.col("found.ts").alias("response_ts"), F.col("found.record_id").alias("response_id"))
    got = c.where("kind = 'revisit'").withColumnRenamed("headers", "new").join(found, ["key", "ts"], "left")
    stored = c.where(full & F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("response_id"), F.col("key").alias("of"), F.col("ts").alias("response_ts")).agg(F.min_by("headers", header_text(F.col("headers"))).alias("old"))
    got = got.join(stored, (got.response_id == stored.response_id) & (got.key == stored.of) & (got.response_ts == stored.response_ts), "left").drop(stored.response_id, stored.response_ts)
    old, new = F.col("old"), F.col("new")
    tags = old["etag"].isNotNull() & new["etag"].isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("response_id").isNull(), "no-response")
        .when(tags, F.when(_opaque(old["etag"]) == _opaque(new["etag"]), "resolved").otherwise("etag-mismatch"))
        .when(dates, F.when(old["last-modified"] == new["last-modified"], "resolved").otherwise("modified-since"))
        .otherwise("unvalidated")
    )
    named = F.transform(F.split(F.coalesce(new["connection"], F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    fresh = F.map_filter(new, lambda k, _: ~k.isin(*NOT_UPDATED) & ~F.array_contains(named, k))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k))
    got = got.withColumn("outcome", outcome)
    return got.select("record_id", F.col("key").alias("canonical"), "response_id", "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, fresh)).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log from pages: each page is fetched in full, visited again under a variant of its URL, and its host's
    robots file is asked for, in full for one page in sixteen (by content)."""
    etag = lambda x: F.concat(F.lit('"'), F.substring(F.md5(x), 1, 16), F.lit('"'))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("page_id", "url", etag(F.col("html")).alias("etag"), F.substring(F.md5("html"), 1, 1).alias("d"), F.length("html").cast("string").alias("size"), F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1).alias("site"))
    day = F.floor(F.col("page_id") / 100).cast("string")
    robots = F.concat(F.lit('"r'), F.floor(F.col("page_id") / 500).cast("string"), F.lit('"'))
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)])
    full = p.select(
        (F.col("page_id") * 4).alias("record_id"), "url", F.lit("response").alias("kind"), (F.col("page_id") * 60).alias("ts"),
        m(etag="etag", last_modified=day, content_type=F.lit("text/html"), content_length="size", cache_control=F.lit("max-age=60"), server=F.lit("a")).alias("headers"),
    )
    variant = F.concat(F.upper(F.regexp_extract("url", "^([A-Za-z]+://)", 1)), F.regexp_replace(F.expr("substring(url, instr(url, '://') + 3)"), "[/#].*$", ""), F.lit(""), F.regexp_extract("url", "^[A-Za-z]+://[^/#]*(/[^#]*)", 1))
    variant = F.concat(variant, F.when(F.contains(variant, F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=feed#x"))
    again = p.select(
        (F.col("page_id") * 4 + 1).alias("record_id"), variant.alias("url"), F.lit("revisit").alias("kind"), (F.col("page_id") * 60 + 86_400).alias("ts"),
        F.when(F.col("d") < "4", m(last_modified=day, cache_control=F.lit("max-age=90"), content_length=F.lit("0")))
        .when(F.col("d") < "6", m(etag=F.lit('"other"'), cache_control=F.lit("max-age=90")))
        .otherwise(m(etag=F.concat(F.lit("W/"), "etag"), cache_control=F.lit("max-age=90"), connection=F.lit("x-hop"), x_hop=F.lit("1"), content_length=F.lit("0"))).alias("headers"),
    )
    host = p.select(
        (F.col("page_id") * 4 + 2).alias("record_id"), F.concat("site", F.lit("/robots.txt")).alias("url"), F.when(F.col("d") == "0", "response").otherwise("revisit").alias("kind"), (F.col("page_id") * 60).alias("ts"),
        m(etag=robots, server=F.concat(F.lit("s"), day)).alias("headers"),
    )
    return full.unionByName(again).unionByName(host)


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


# -- files -------------------------------------------------------------------

_RECORD = "record_type string, url string, date string, status int, headers map<string,string>, body binary, warc_id string, profile string, refers_to string, payload_digest string"
#: The fields of a record's own header that read_records() adds, in this order.
_OWN = ("warc-record-id", "warc-profile", "warc-refers-to", "warc-payload-digest")
# How the profiles of revisits end.
NOT_MODIFIED, SAME_PAYLOAD = "/revisit/server-not-modified", "/revisit/identical-payload-digest"


def write_record(kind: str, url: str, date: str, status: int, headers: dict[str, str], body: bytes, **own: str) -> bytes:
    """One gzip member with one WARC/1.1 record. own: further fields of its header, `record_id` for WARC-Record-ID and so on."""
    http = (f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + body
    more = "".join(f"WARC-{'-'.join(x.upper() if x == 'id' else x.capitalize() for x in k.split('_'))}: {v}\r\n" for k, v in own.items())
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return gzip.compress(head.encode() + http + b"\r\n\r\n", mtime=0)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in lines:
        k, _, v = x.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def read_records(data: bytes):
    """The records of a WARC file, gzip or plain, inflated as they are read; a record or gzip member that is cut short or
    damaged, or has no number for a length, ends the file."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    with contextlib.suppress(EOFError, OSError, zlib.error):  # a member that is cut short or damaged
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                return
            lines = []
            while (line := f.readline()).strip():
                lines.append(line.rstrip(b"\r\n"))
            head = _fields(lines)
            size = head.get("content-length", "0")
            if not line or not size.isascii() or not size.isdigit():
                return
            payload = f.read(int(size))
            if len(payload) < int(size):
                return
            status, headers, body = None, {}, payload
            if head.get("content-type", "").startswith("application/http"):
                top, _, body = payload.partition(b"\r\n\r\n")
                first, *rest = top.split(b"\r\n")
                parts = first.split()
                status = int(parts[1]) if len(parts) > 1 and parts[1].isascii() and parts[1].isdigit() else None
                headers = _fields(rest)
            yield head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), status, headers, body, *(head.get(k) for k in _OWN)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at a path or glob; a file is one task's work (files are about 1 GB by custom)."""

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                rows: list = []
                size = 0
                for r in read_records(data.as_py()):
                    rows.append(r)
                    size += len(r[5])
                    if size > 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def _records(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), *[pa.string()] * 4]
    data = [list(c) if i != 4 else [list(h.items()) for h in c] for i, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])


def captures_of_records(records: DataFrame) -> DataFrame:
    """read_warc() -> a capture log: record_id, url, kind, ts, headers, and warc_id, refers_to, payload_digest. kind: 'response' for
    full answers, 'revisit' for not-modified ones (by profile, or without one by status 304), 'identical' for those whose body is
    another record's; other records are left out. A date that can't be read is null."""
    ends = lambda what: F.coalesce(F.col("profile").endswith(what), F.lit(False))
    not_modified = F.coalesce(F.col("status") == 304, F.lit(False))
    kind = F.when(F.col("record_type") == "response", F.when(not_modified, "revisit").otherwise("response"))
    kind = kind.when(F.col("record_type") == "revisit", F.when(ends(SAME_PAYLOAD), "identical").when(ends(NOT_MODIFIED) | not_modified, "revisit"))
    ts = F.unix_timestamp(F.try_to_timestamp("date"))
    own = F.when(F.col("warc_id").isNotNull(), F.xxhash64("warc_id"))
    return records.select(own.alias("record_id"), "url", kind.alias("kind"), ts.alias("ts"), "headers", "warc_id", "refers_to", "payload_digest").where("kind is not null")


def resolve_identical(captures: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """captures_of_records() -> record_id, canonical, response_id, outcome for every 'identical' record: 'identical' with the response
    that has its payload, 'digest-mismatch' where the response that it names has another digest, 'no-response' without any. Its own
    headers stand; only the body is the response's."""
    c = captures.where("kind in ('response', 'identical')").withColumn("key", canonical_url(F.col("url")))
    full = c.where("kind = 'response' and record_id is not null")
    named = full.where("warc_id is not null").groupBy(F.col("warc_id").alias("name")).agg(F.max("record_id").alias("named_id"), F.max("payload_digest").alias("named_digest"))
    by_digest = c.where("payload_digest is not null and ts is not null").select(F.col("payload_digest").alias("key"), "ts", "record_id", (F.col("kind") == "response").alias("full"))
    found = latest_before(by_digest, bucket_seconds).where("found is not null").select(F.col("key").alias("digest"), F.col("ts").alias("at"), F.col("found.record_id").alias("found_id"))
    got = c.where("kind = 'identical'").join(named, F.col("refers_to") == F.col("name"), "left")
    got = got.join(found, (F.col("payload_digest") == F.col("digest")) & (F.col("ts") == F.col("at")), "left")
    unlike = F.coalesce(F.col("named_digest") != F.col("payload_digest"), F.lit(False))
    response = F.when(F.col("named_id").isNotNull(), F.col("named_id")).otherwise(F.col("found_id"))
    outcome = F.when(F.col("named_id").isNotNull() & unlike, "digest-mismatch").when(response.isNull(), "no-response").otherwise("identical")
    return got.select("record_id", F.col("key").alias("canonical"), F.when(outcome == "identical", response).alias("response_id"), outcome.alias("outcome"))
