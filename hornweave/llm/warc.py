"""WARC records, and resolution of not-modified revisits.

A revisit of the profile ``server-not-modified`` holds only the headers of a 304 answer.
It is joined as of its date with the latest earlier full response of the same canonical
URL. Their validators must agree: entity tags (compared weakly) if both have one, else
modification dates if both have one; without either the answer is taken as it is. The
permitted headers of the 304 answer then replace all of the same name in the stored
response. Headers are lists of (name, value) in their order, so repeated ones stay.

The as-of step works on (date, id) only. Per URL and time bucket the latest response is
pre-aggregated, a running maximum over buckets carries it on, and a window inside a
bucket finds nearer ones, so a URL with a large share of all records is split by time.
Headers and payloads are joined by id afterwards.

Defined cases: a null or empty URL matches nothing; a record without a date or an id is
no source and a revisit without them is an orphan; null payload is empty; a header
without a value is left out, line breaks in a URL are dropped and those in a header's
value are spaces; records of equal dates are ordered by id; of records that repeat an id
one is its source, chosen by a hash of the content, and every revisit row is resolved
once; blocks other than HTTP (such as warcinfo) have no status and no headers; header
bytes that aren't UTF-8 are read as Latin-1; a date or status that can't be read is null
and named in ``error``; a damaged record gives a row with nothing but ``error``, and
reading goes on at the next record; of a repeated validator the first one counts; further
columns of the input, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers of a 304 answer that must not replace stored ones (content framing and hop-by-hop fields).
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"id long, url string, ts long, kind string, status int, headers {HEADERS}, payload binary"
COLUMNS = ["id", "url", "ts", "kind", "status", "headers", "payload"]


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, ``www.``, fragment, tracking parameters and (without a query) trailing slashes; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.translate(url, "\r\n", "")), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^.*@|:(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    own = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&", -1), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^(utm_[a-z]+|ref)(=|$)")))
    rest = F.when(F.size(own) > 0, F.concat(path, F.lit("?"), F.array_join(own, "&"))).otherwise(F.regexp_replace(path, r"/+$", ""))
    return F.when(F.length(host) > 0, F.concat(host, rest))


def to_warc(rows: DataFrame) -> DataFrame:
    """(id, record): WARC/1.1 bytes of every row of the RECORD columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [serialise(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "record"])

    return rows.select(*COLUMNS).mapInArrow(run, "id long, record binary")


def serialise(r: dict) -> bytes:
    fields = [(x["name"], re.sub(r"[\r\n]+", " ", x["value"])) for x in r["headers"] or () if x and x["name"] is not None and x["value"] is not None]
    http = f"HTTP/1.1 {'' if r['status'] is None else r['status']} \r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    block = http.encode() + (r["payload"] or b"")
    url = None if r["url"] is None else re.sub(r"[\r\n]", "", r["url"])
    head = {"WARC-Type": r["kind"], "WARC-Record-ID": None if r["id"] is None else f"<urn:record:{r['id']}>", "WARC-Date": r["ts"], "WARC-Target-URI": url}
    head |= {"WARC-Profile": PROFILE if r["kind"] == "revisit" else None, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _fields(lines: list[str]) -> list[dict[str, str]]:
    return [{"name": k.lower(), "value": v.strip(" \t")} for k, colon, v in (x.partition(":") for x in lines) if colon]


def _number_of(record_id: str | None) -> int | None:
    """The number in a record id; of another id (such as a UUID), 62 bits of a hash."""
    if record_id is None:
        return None
    last = record_id.rpartition(":")[2].rstrip(">")
    number = int(last) if re.fullmatch(r"-?[0-9]{1,19}", last) else 1 << 63
    return number if -(1 << 63) <= number < 1 << 63 else int.from_bytes(hashlib.blake2b(record_id.encode(), digest_size=8).digest(), "big") >> 2


def _seconds_of(date: str | None) -> int | None:
    """A date as a number, or the epoch seconds of an ISO date."""
    if date is None:
        return None
    found = int(date) if re.fullmatch(r"-?[0-9]+", date) else int(datetime.fromisoformat(date).timestamp())
    if not -(1 << 63) <= found < 1 << 63:
        raise ValueError("a date out of range")
    return found


def parse(data: bytes) -> list[dict]:
    """All records of a WARC file's bytes, damaged ones as rows with an error."""
    out, at = [], 0
    while at < len(data):
        record, end = _record(data, at)
        out.append(record)
        if end is None:  # the next record, if any, begins after a line
            found = re.compile(rb"\r\n(?=WARC/1\.)").search(data, at + 1)
            end = found.end() if found else len(data)
        at = end
    return out


def _record(data: bytes, at: int) -> tuple[dict, int | None]:
    """The record that begins here, and where it ends (None if it is damaged)."""
    empty = dict.fromkeys(COLUMNS)
    end = data.find(b"\r\n\r\n", at)
    lines = _text(data[at:end]).split("\r\n") if end > 0 else [""]
    head = {x["name"]: x["value"] for x in reversed(_fields(lines[1:]))}
    if not lines[0].startswith("WARC/1.") or not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        return empty | {"error": f"no WARC record at byte {at}"}, None
    start, size = end + 4, int(head["content-length"])
    block = data[start : start + size]
    if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        return empty | {"error": f"damaged WARC record at byte {at}"}, None
    errors, ts, status, fields, payload = [], None, None, [], block
    try:
        ts = _seconds_of(head.get("warc-date"))
    except (ValueError, OverflowError):
        errors.append("date")
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        first, *rest = _text(http).split("\r\n")
        code, fields = (first.split(" ") + [""])[1], _fields(rest)
        if re.fullmatch("[0-9]{1,9}", code):
            status = int(code)
        elif code:
            errors.append("status")
    record = {
        "id": _number_of(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "ts": ts, "kind": head.get("warc-type"),
        "status": status, "headers": fields, "payload": payload, "error": ", ".join(f"unreadable {e}" for e in errors) or None,
    }
    return record, start + size + 4


def from_warc(files: DataFrame, column: str = "record") -> DataFrame:
    """The RECORD columns, and ``error``, of every record in a binary column of WARC bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        types = dict(zip([*COLUMNS, "error"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), header, pa.binary(), pa.string()], strict=True))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = [r for data in batch.column(0).slice(start, 500).to_pylist() if data is not None for r in parse(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], names=list(types))

    return files.select(column).mapInArrow(run, f"{RECORD}, error string")


def latest_before(rows: DataFrame, bucket: int) -> DataFrame:
    """(id, ts, place, source_id) of every revisit with a date and a place: the latest earlier full response there, or null."""
    own = F.struct("ts", "id")
    full = (F.col("kind") == "response") & F.col("status").between(200, 299)
    r = rows.select("id", "ts", "kind", canonical_url(F.col("url")).alias("place"), F.when(full, own).alias("full"), F.floor(F.col("ts") / bucket).alias("bucket"))
    r = r.where("place is not null and ts is not null and id is not null and (full is not null or kind = 'revisit')")
    in_order = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = r.groupBy("place", "bucket").agg(F.max("full").alias("last"), F.max(F.col("kind") == "revisit").alias("asked"))
    carried = carried.select("place", "bucket", "asked", F.max("last").over(in_order).alias("carried")).where("asked").drop("asked")
    inside = Window.partitionBy("place", "bucket").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.max("full").over(inside)).where("kind = 'revisit'")
    return near.join(carried, ["place", "bucket"]).select("id", "ts", "place", F.coalesce("near.id", "carried.id").alias("source_id"))


def resolve(rows: DataFrame, bucket: int = 3600) -> DataFrame:
    """Every record with its resolved status, headers and payload, and how it was resolved.

    outcome: ``full`` (not a revisit), ``resolved``, ``mismatch`` (validators differ; the
    record stays as it is) or ``orphan`` (no earlier full response).
    """
    rows = rows.select(*COLUMNS)
    revisit = rows.where("kind = 'revisit'").withColumn("place", canonical_url(F.col("url")))
    found = latest_before(rows, bucket).where("source_id is not null").distinct()
    # only responses that a revisit refers to; their payloads and headers are dealt by id once, for this and both steps after it
    wanted = rows.where("kind = 'response' and id is not null").withColumnRenamed("id", "source_id").join(found.select("source_id"), "source_id", "left_semi")
    content = F.struct(F.col("status").alias("s_status"), F.col("headers").alias("s_headers"), F.col("payload").alias("s_payload"))
    source = wanted.groupBy("source_id").agg(F.min_by(content, F.xxhash64("status", header_lines(F.col("headers")), "payload")).alias("s")).select("source_id", "s.*")
    joined = revisit.join(found, ["id", "ts", "place"], "left").join(source, "source_id", "left")
    h, s = (F.coalesce(c, F.array().cast(HEADERS)) for c in (F.col("headers"), F.col("s_headers")))
    first = lambda c, name: F.get(F.filter(c, lambda x: x["name"] == name), F.lit(0))["value"]
    tag = lambda c: F.regexp_replace(first(c, "etag"), "^W/", "")
    agree = F.coalesce(tag(h) == tag(s), first(h, "last-modified") == first(s, "last-modified"), F.lit(True))
    outcome = F.when(F.col("source_id").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    good = F.col("outcome") == "resolved"
    permitted = F.filter(h, lambda x: ~x["name"].isin(NOT_MERGED))
    stored = F.filter(s, lambda x: ~F.array_contains(F.transform(permitted, lambda y: y["name"]), x["name"]))
    joined = joined.withColumn("outcome", outcome).select(
        "id", "url", "ts", "kind", "outcome", "source_id", F.when(good, F.col("s_status")).otherwise(F.col("status")).alias("status"),
        F.when(good, F.concat(stored, permitted)).otherwise(F.col("headers")).alias("headers"), F.when(good, F.col("s_payload")).otherwise(F.col("payload")).alias("payload"),
    )
    rest = rows.where("kind is null or kind <> 'revisit'").select("id", "url", "ts", "kind", F.lit("full").alias("outcome"), F.lit(None).cast("long").alias("source_id"), "status", "headers", "payload")
    return joined.unionByName(rest)


def header_lines(headers: Column) -> Column:
    """``name: value`` lines by name, then value."""
    return F.array_join(F.transform(F.array_sort(headers), lambda e: F.concat(e["name"], F.lit(": "), e["value"])), "\n")


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """Records of a crawl that fetched every page twice: a full response, later a conditional request answered by 304.

    Some pages have no entity tag, some no modification date either; dates are seconds from the page's number. Every
    response sets two cookies, every other 304 answer one.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    etag = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit('"'), F.md5("html"), F.lit('"')))
    modified = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string")))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    clean = lambda *pairs: F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())
    common = [pair("etag", etag), pair("last-modified", modified)]
    cookie = lambda name, m: pair("set-cookie", F.concat(F.lit(name + "="), (F.col("page_id") % m).cast("string")))
    first = clean(*common, pair("cache-control", F.lit("max-age=60")), pair("content-length", F.octet_length("html")), pair("content-type", F.lit("text/html")), cookie("a", 7), cookie("b", 3))
    later = clean(
        *common, pair("cache-control", F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string"))), pair("content-length", F.lit("0")),
        pair("set-cookie", F.when(F.col("page_id") % 2 == 0, F.lit("c=1"))),
    )
    response = p.select((2 * F.col("page_id")).alias("id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), first.alias("headers"), F.col("html").alias("payload"))
    revisit = p.select((2 * F.col("page_id") + 1).alias("id"), "url", (F.col("page_id") + 1000 * (F.col("page_id") % 3)).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), later.alias("headers"), F.lit(b"").alias("payload"))
    return response.unionAll(revisit)


def digest(resolved: DataFrame) -> DataFrame:
    """One row for each record; ``source_id`` is -1 where there is none."""
    return resolved.select(
        F.col("id").alias("record_id"), "outcome", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "status", F.sha2(header_lines(F.col("headers")).cast("binary"), 256).alias("headers_sha256"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
    )
