"""WARC archives: writing, reading, and transaction assembly.

Writing: each page becomes a request, a response (or a revisit of an earlier identical payload) and a metadata record.
Archives are written by Spark's text writer, a record a row, with the blank lines that end a WARC record as the line
separator, so any store that Spark writes to can hold them; each file is one gzip stream.

Reading: archives are read by Spark's text reader, split at the version lines of WARC 1.0 and 1.1 that start a record. A payload
that holds such a line's beginning itself is split too, so the parts are put together again by Content-Length, in the order of the file (gzip
files, which write_archive writes, aren't split between tasks). Only a record at a time is held.

Assembly: request and metadata records name the captures that they belong to by WARC-Concurrent-To, which may stand several
times: such a record is in the row of each capture that it names. A record that names another request or metadata record
belongs to what that one names, over as many steps as it takes. Responses and revisits
are the captures; the others are joined to them, and one nested row per capture comes out. What leads to no known capture,
or in a circle, is in no row.

Null html is an empty payload. Records of equal payloads of at least `MIN_REVISIT` bytes: that with the largest page_id
is the response, the others revisit it; shorter ones are always responses. A null page_id is below all others (written as
"none"), so such a page revisits one with an id, or is a response. Rows that share a page_id are told apart by their
payload's digest; equal rows are captures of one identifier, each with all requests and metadata that name it. Null urls are
written as "urn:none". Very long payloads are written and read whole, one record in memory at a time. An empty table gives an
empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, new_path, ship, table

MIN_REVISIT = 1000
VERSION = "WARC/1.1"
#: What records are split at; a version line goes on with one of these.
MARK, VERSIONS = "WARC/1.", (b"0\r\n", b"1\r\n")
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bytes_in(column):
    return F.octet_length(column).cast("string")


def _record(headers: list[tuple[str, object]], block) -> F.Column:
    """A record's text but for the two line ends after it."""
    lines = [F.lit(VERSION + CRLF)]
    for name, value in headers:
        lines += [F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise(F.lit(""))]
    return F.concat(*lines, F.lit("Content-Length: "), _bytes_in(block), F.lit(CRLF + CRLF), block)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): pages with the payload's SHA-1, and the page that a revisit refers to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("urn:none")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "digest").join(large.where("n > 1"), "digest").where("NOT page_id <=> last")
    copies = copies.select(F.col("page_id").alias("c_id"), F.col("digest").alias("c_digest"), F.col("last").alias("refers_to")).distinct()
    return rows.join(copies, F.expr("page_id <=> c_id AND digest = c_digest"), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write gzip'd WARC files of request, response or revisit, and metadata records."""
    rows = plan_records(pages, min_revisit)
    one_line = lambda c: F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")  # noqa: E731  a header is a line
    rows = rows.withColumn("uri", one_line(F.col("url"))).withColumn("page_name", F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).withColumn("name", F.concat_ws("-", "page_name", "digest"))
    ident = lambda kind, name=F.col("name"): F.concat(F.lit(f"<urn:{kind}:"), name, F.lit(">"))
    date = ("WARC-Date", F.lit(DATE))
    target = ("WARC-Target-URI", F.col("uri"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), _bytes_in(F.col("html")), F.lit(CRLF + CRLF))
    is_revisit = F.col("refers_to").isNotNull()
    capture = _record(
        [
            ("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", ident("capture")),
            date,
            target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(is_revisit, ident("capture", F.concat_ws("-", "refers_to", "digest")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(is_revisit, http).otherwise(F.concat(http, "html")),
    )
    to_capture = ("WARC-Concurrent-To", ident("capture"))
    path_of = F.coalesce(F.nullif(F.regexp_extract("uri", r"^[^:]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", ident("request")), date, target, to_capture, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract("uri", r"^[^:]*://([^/?#]*)", 1), F.lit(CRLF + CRLF)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", ident("metadata")), date, target, to_capture, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), "page_name", F.lit(f"{CRLF}fetchTimeMs: 0{CRLF}")),
    )
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)", re.I)


def _headers(head: bytes) -> dict[str, list[str]]:
    """Values of each header, in order: WARC-Concurrent-To may stand several times."""
    found: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split(CRLF):
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), []).append(value.strip())
    return found


def split_records(parts: Iterator[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
    """(header lines, block) of each record, from pieces between marks; None stands for the start of a file. A piece that begins
    with the rest of a version line, of 1.0 or 1.1, begins a record. One that ends before its record's Content-Length is up holds
    a mark in its text, and is joined to the next."""
    mark, held, have, need = MARK.encode(), None, 0, 0
    for part in parts:
        if part is None:
            held = None
            continue
        if held is not None:
            held.append(mark + part)
            have += len(mark) + len(part)
        elif part.startswith(VERSIONS):
            part = part[len(VERSIONS[0]) :]
            split = part.find(b"\r\n\r\n")
            length = _LENGTH.search(part[: split + 2]) if split >= 0 else None
            if length is None:
                continue  # a broken one
            held, have, need = [part], len(part), split + 4 + int(length[1])
        else:
            continue  # nothing that can be read: before the first record, or behind a whole one
        if have >= need:
            whole = b"".join(held)
            head = whole.find(b"\r\n\r\n")
            yield whole[:head], whole[head + 4 : need]
            held = None


_RECORD = "record_id string, record_type string, concurrent_to array<string>, refers_to string, uri string, payload_digest string, digest_ok boolean, payload_bytes long"


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        names = ["record_id", "record_type", "concurrent_to", "refers_to", "uri", "payload_digest", "digest_ok", "payload_bytes", "fields"]
        types = [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.bool_(), pa.int64(), pa.string()]
        if with_payload:
            names, types = [*names, "payload"], [*types, pa.binary()]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def pieces() -> Iterator[bytes | None]:
            file = None
            for batch in batches:
                for name, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
                    if name != file:
                        file = name
                        yield None
                    yield value or b""

        for head, block in split_records(pieces()):
            every = _headers(head)
            own = {k: v[0] for k, v in every.items()}
            kind = own.get("warc-type")
            payload, size, good, fields = b"", None, None, None
            digest = own.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
            if kind in ("response", "revisit"):
                http, _, payload = block.partition(b"\r\n\r\n")
                declared = _LENGTH.search(http)
                size = int(declared[1]) if kind == "revisit" and declared else len(payload)
                if kind == "response":
                    true = hashlib.sha1(payload).hexdigest()
                    good, digest = digest in (None, true), true
            elif kind == "metadata":
                fields = block.decode("utf-8", "replace")
            rows.append(
                (own.get("warc-record-id"), kind, every.get("warc-concurrent-to", []), own.get("warc-refers-to"), own.get("warc-target-uri"), digest, good, size, fields)
                + ((payload,) if with_payload else ())
            )
            held += len(payload) if with_payload else 0
            if len(rows) >= 5000 or held > 16_000_000:
                yield flush()
                rows.clear()
                held = 0
        yield flush()

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per WARC record; payload only if asked for."""
    ship(spark)
    lines = spark.read.option("lineSep", MARK).text(path)
    parts = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return parts.mapInArrow(_parse(with_payload), _RECORD + ", fields string" + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the capture's columns, its request and its metadata records."""
    held = [c for c in ("payload", "payload_bytes", "payload_digest", "digest_ok") if c in records.columns]
    captures = records.where("record_type IN ('response', 'revisit')").select("record_id", "record_type", "refers_to", "uri", *held)
    others = records.where("record_type IN ('request', 'metadata')").select("record_id", "record_type", "fields", "concurrent_to", F.monotonically_increasing_id().alias("uid"))
    # uid tells records apart, also those that repeat an id
    others = materialize(others.select("uid", "record_id", "record_type", "fields", F.explode(F.array_distinct("concurrent_to")).alias("at")), "warc-others")
    # what a request or metadata record is concurrent to may be another of these, and several: each way is followed until it is
    # at a capture or where it has been
    steps = others.select(F.col("record_id").alias("via_id"), F.col("at").alias("via_to")).distinct()
    known = captures.select(F.col("record_id").alias("at")).distinct()
    front = materialize(others.select("uid", "at").distinct(), "warc-steps")
    been = [front]
    while True:
        ahead = front.join(known, "at", "left_anti").join(steps, F.col("at") == F.col("via_id")).select("uid", F.col("via_to").alias("at")).distinct()
        ahead = ahead.join(reduce(DataFrame.union, been), ["uid", "at"], "left_anti")
        front = materialize(ahead, "warc-steps")
        if front.isEmpty():
            break
        been.append(front)
    reached = reduce(DataFrame.union, been).join(known, "at", "left_semi").withColumnRenamed("at", "capture")
    others = others.select("uid", "record_id", "record_type", "fields").dropDuplicates(["uid"]).join(reached, "uid")
    asked = others.where("record_type = 'request'").groupBy("capture").agg(F.min("record_id").alias("request_id"), F.count("*").alias("n_requests"))
    told = others.where("record_type = 'metadata'").groupBy("capture").agg(
        F.array_sort(F.collect_list(F.struct("record_id", "fields"))).alias("metadata")
    )
    out = captures.join(asked, captures["record_id"] == asked["capture"], "left").drop("capture")
    out = out.join(told, out["record_id"] == told["capture"], "left").drop("capture")
    return out.select(*captures.columns, F.struct(F.col("request_id").alias("record_id"), F.coalesce("n_requests", F.lit(0)).alias("n")).alias("request"), "metadata")


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    rows = assemble(materialize(read_records(spark, path), "warc-records"))
    told = F.regexp_extract(F.element_at("metadata", 1)["fields"], r"pageId: (-?\d+)", 1).cast("long")
    referred = F.regexp_extract("refers_to", r"<urn:capture:(-?\d+)-", 1)
    return rows.select(
        told.alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", referred.cast("long")).alias("refers_to"),
        F.col("request.n").alias("n_requests"),
        F.size("metadata").cast("long").alias("n_metadata"),
        F.to_json("request").alias("request"),
        F.to_json("metadata").alias("metadata"),
    )


def oracle() -> str:
    return f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
    w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN last END AS refers_to,
        1::BIGINT AS n_requests, 1::BIGINT AS n_metadata, '{{"record_id":"<urn:request:' || page_id || '-' || payload_digest || '>","n":1}}' AS request,
        '[{{"record_id":"<urn:metadata:' || page_id || '-' || payload_digest || '>","fields":"pageId: ' || page_id || '\\r\\nfetchTimeMs: 0\\r\\n"}}]' AS metadata FROM w"""
