"""WARC records: reading, writing, and resolving not-modified revisits.

A revisit record says that a server answered 304: the body is that of an earlier full response. It
is resolved by an as-of join on the canonical URL, with its validators checked and its permitted
headers merged into the stored ones.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header fields of a 304 response that never replace stored ones: they describe the message or the body.
KEPT_AS_STORED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-md5",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
RECORD = "path string, offset long, record_id string, kind string, url string, date string, digest string, warc map<string,string>, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """One spelling per resource: lower-case scheme and host, no default port, fragment, user or
    trailing dot, `/` for an empty path, parameters in order. Null and blank URLs are null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    whole = F.concat(
        scheme,
        F.lit("://"),
        F.regexp_replace(host, r"\.$", ""),
        F.when(usual, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&"))),
    )
    return F.when(u == "", None).when(scheme == "", u).otherwise(whole)


def _field(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of a repeated name the value that sorts last stays."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, bucket: str = "day") -> DataFrame:
    """Each revisit with the full response that it stands for.

    `records` has record_id, kind (response or revisit), url, date (timestamp), status, headers
    (map) and digest. Out come record_id, url_key, date, response_id, response_date, outcome and
    headers. The response is the latest one of status 200 with the same canonical URL and an
    earlier date, of equal dates the greatest record_id. `outcome` is

    - `resolved`: the revisit's entity tag (compared weakly), else its Last-Modified, else its
      payload digest equals the stored one;
    - `unverified`: the two share no validator;
    - `mismatch`: the strongest validator that both have differs; no headers are merged;
    - `orphan`: there is no earlier full response, or no URL or date.

    Merged headers are the stored ones, replaced by those of the revisit that a 304 may update.
    Header names are compared in lower case. Repeated rows give repeated results, an empty table an
    empty one; other columns are not read.

    A URL's history is cut into buckets of time, so that no task holds a hot one: within a bucket a
    window carries the latest response forward; across buckets only one row each is carried.
    """
    rows = records.select(
        "record_id",
        "kind",
        canonical(F.col("url")).alias("url_key"),
        F.col("date"),
        F.date_trunc(bucket, "date").alias("bucket"),
        "status",
        lower_keys(F.col("headers")).alias("headers"),
        "digest",
    )
    usable = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    full = (F.col("kind") == "response") & (F.col("status") == 200) & usable
    known = rows.filter(full | (F.col("kind") == "revisit"))
    own = F.struct(F.col("date").alias("at"), F.col("record_id").alias("id"), "headers", "digest")
    order = F.struct("date", "record_id")

    # the latest response of each bucket, with map-side combine, then of all earlier buckets
    ends = rows.filter(full).groupBy("url_key", "bucket").agg(F.max_by(own, order).alias("end"))
    by_url = Window.partitionBy("url_key").orderBy("bucket")
    asked = known.filter((F.col("kind") == "revisit") & usable).groupBy("url_key", "bucket").agg(F.lit(1).alias("asked"))
    carried = ends.join(asked, ["url_key", "bucket"], "full_outer")
    carried = carried.withColumn("before", F.last("end", ignorenulls=True).over(by_url.rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.filter("asked = 1").select("url_key", "bucket", "before")

    # earlier means a smaller date: at equal dates revisits come first
    is_full = F.when(F.col("kind") == "response", 1).otherwise(0)
    within = Window.partitionBy("url_key", "bucket").orderBy("date", is_full, "record_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("kind") == "response", own), ignorenulls=True).over(within)
    revisits = known.filter(usable).withColumn("near", latest).filter("kind = 'revisit'").join(carried, ["url_key", "bucket"], "left")
    found = revisits.withColumn("stored", F.coalesce("near", "before"))
    lost = known.filter((F.col("kind") == "revisit") & ~usable).withColumn("stored", F.lit(None).cast(found.schema["stored"].dataType))
    found = found.select(*lost.columns).unionByName(lost)

    tag = lambda h: F.regexp_replace(_field(h, "etag"), r"^[Ww]/", "")
    old, new = F.col("stored.headers"), F.col("headers")
    checks = [(tag(old), tag(new)), (_field(old, "last-modified"), _field(new, "last-modified")), (F.col("stored.digest"), F.col("digest"))]
    agree = F.coalesce(*[a == b for a, b in checks])
    outcome = F.when(F.col("stored").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter(new, lambda k, v: ~k.isin(*KEPT_AS_STORED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return found.select(
        "record_id",
        "url_key",
        "date",
        F.col("stored.id").alias("response_id"),
        F.col("stored.at").alias("response_date"),
        outcome.alias("outcome"),
        F.when(outcome.isin("resolved", "unverified"), merged).alias("headers"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their response, joined once at the end."""
    bodies = records.filter("kind = 'response'").select(F.col("record_id").alias("response_id"), "body")
    return resolved.join(bodies, "response_id", "left")


def captures(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """A crawl history of a table of pages: records without bodies, for `resolve`.

    Page p is fetched in full on day p mod 5, with an entity tag of its body's digest (or, every
    seventh, none), and asked for again on the three days after; of these answers every eleventh
    has another entity tag. The history depends on the columns alone.
    """
    p = F.col(key)
    digest = F.concat(F.lit("md5:"), F.md5(F.coalesce(F.col(body), F.lit("")).cast("binary")))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    base = pages.filter(p.isNotNull()).select(p.alias("p"), "url", digest.alias("digest"))
    rows = base.withColumn("visit", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    day = F.pmod("p", F.lit(5)) + F.col("visit")
    tag = F.when(F.pmod("p", F.lit(7)) == 0, None).when((F.col("visit") > 0) & (F.pmod(F.col("p") + F.col("visit"), F.lit(11)) == 0), F.lit('"other"')).otherwise(F.concat(F.lit('W/"'), F.col("digest"), F.lit('"')))
    number = (F.col("p") * 4 + F.col("visit")).cast("long")
    headers = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in ("ETag", "Date", "Content-Length", "Cache-Control")]),
            F.array(tag, day.cast("string"), F.col("visit").cast("string"), F.concat(F.lit("max-age="), F.col("visit").cast("string"))),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(
        number.alias("record_id"),
        F.when(F.col("visit") == 0, "response").otherwise("revisit").alias("kind"),
        "url",
        F.timestamp_seconds(F.unix_timestamp(start) + day * 86400 + F.pmod("p", F.lit(86400))).alias("date"),
        F.when(F.col("visit") == 0, 200).otherwise(304).alias("status"),
        headers.alias("headers"),
        F.when(F.col("visit") == 0, F.col("digest")).alias("digest"),
    )


_HEADER = re.compile(rb"\r?\n\r?\n")


def _fields(block: bytes) -> list[tuple[str, str]]:
    """Header lines; folded ones continue the line before."""
    out: list[tuple[str, str]] = []
    for line in block.splitlines():
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + text.strip())
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip().lower(), value.strip()))
    return out


def parse(data: bytes):
    """(offset, WARC fields, HTTP status, HTTP fields, body) of each record of a plain or gzipped file.

    A file cut off in the middle gives its whole records; HTTP parts are null for other contents.
    """
    if data[:2] == b"\x1f\x8b":
        import zlib

        whole = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            whole.append(member.decompress(data))
            data = member.unused_data.lstrip(b"\0")
        data = b"".join(whole)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        head = _HEADER.search(data, at)
        if not head:
            return
        fields = dict(_fields(data[at : head.start()]))
        try:
            size = int(fields.get("content-length", ""))
        except ValueError:
            at = head.end()
            continue
        block = data[head.end() : head.end() + size]
        if len(block) < size:
            return
        status, http, body = None, None, block
        if "http" in fields.get("content-type", "") and block[:5] == b"HTTP/":
            cut = _HEADER.search(block)
            lines, body = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
            first, _, rest = lines.partition(b"\n")
            words = first.split()
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            http = dict(_fields(rest))
        yield at, fields, status, http, body
        at = head.end() + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, a task per file; `date` is text as in the file."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, at, f.get("warc-record-id"), f.get("warc-type"), (f.get("warc-target-uri") or "").strip("<>") or None, f.get("warc-date"), f.get("warc-payload-digest"), list(f.items()), status, list(http.items()) if http is not None else None, body) for at, f, status, http, body in parse(data.as_py())]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
                names = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def write_record(kind: str, url: str, date: str, record_id: str, status: str, headers: dict[str, str], body: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One gzipped WARC record of an HTTP response."""
    http = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
    fields = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Record-ID": record_id, "Content-Type": "application/http; msgtype=response", **(extra or {}), "Content-Length": str(len(http))}
    return gzip.compress(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + http + b"\r\n\r\n", mtime=0)
