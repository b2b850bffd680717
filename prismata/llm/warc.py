"""WARC archives: written from pages, read back, and assembled into one row per capture.

Writing is done by Spark's text writer, whose line separator is the end of a record, so archives go
to any store that Spark can write. Reading takes each file whole (binaryFile, 2 GB at most), gzip or plain, and unpacks
it a few hundred kB at a time; so the writer begins a new gzip file whenever one has as many records as pages of
average size make FILE_BYTES. Records are cut by their Content-Length, never by searching for a mark, so payloads
may hold anything.

Assembly joins request, response (or revisit) and metadata records through WARC-Concurrent-To, in
either direction, and also where metadata names the request rather than the response.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_dir, table, text_or_empty, written

#: Payloads of at least so many bytes are written once; later ones with the same digest are revisits.
LEAST_BYTES = 0
#: The date of all records, unless the caller has one: archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: Bytes of payloads that a file has, if its pages are of average size.
FILE_BYTES = 64 << 20

RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes bigint, http_status int, block string, payload binary"


def base32_sha1(column):
    """SHA-1 in base 32 (RFC 4648), without Python: 20 bits at a time through Spark's conv."""
    text = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(text, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, page, digest):
    """A URN made from the page's id and payload, the same whenever it is made."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if i > 1 else ""), F.substring(h, i, n))], F.lit(">"))


def _record(headers: list, block):
    """headers: pairs of a name and a column; those that are null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(END))) for k, v in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit(f"WARC/1.1{END}"), F.concat_ws("", *lines), F.lit("Content-Length: "), size, F.lit(END + END), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of pages (page_id, url, html)."""
    html = text_or_empty("html")
    mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 0
    rows = pages.select(F.col("page_id"), F.regexp_replace("url", "[\\r\\n\\t ]+", "%20").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("bigint"))
    # Digests that come more than once, with the smallest page_id of each: combined on the map side, without html.
    again = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(written(again, "repeated-payloads"), "digest", "left")
    page, digest = F.col("page_id"), F.col("digest")
    revisit = F.col("first").isNotNull() & ~page.eqNullSafe(F.col("first"))
    # A null page_id can't be a first one where another id is, and where there is none, each is a response.
    own = record_id("capture", page, digest)
    labelled = F.concat(F.lit("sha1:"), digest)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.nullif(F.col("url"), F.lit("")))]
    capture = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            *shared,
            ("WARC-Payload-Digest", labelled),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(revisit, record_id("capture", F.col("first"), digest))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", page, digest)), *shared, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", page, digest)), *shared, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(END)),
    )
    between = F.lit(END + END)
    rows.select(F.concat(request, between, capture, between, metadata).alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 2000)))).text(path)


class Unpacked:
    """The bytes of an archive, plain or gzip (in one member or many), unpacked only as far as they are asked for."""

    STEP = 1 << 18

    def __init__(self, data: bytes):
        self.data, self.pos, self.held, self.at = data, 0, bytearray(), 0
        self.packed, self.z = data[:2] == b"\x1f\x8b", None

    def fill(self, need: int) -> bool:
        """Hold `need` bytes from `at` on; False if there aren't so many."""
        import zlib

        if self.at > 1 << 20:  # what was read goes now and then, not for each record
            del self.held[: self.at]
            self.at = 0
        while len(self.held) - self.at < need and (self.pos < len(self.data) or self.z and self.z.unconsumed_tail):
            if not self.packed:
                self.held += self.data[self.pos : self.pos + self.STEP]
                self.pos += self.STEP
                continue
            self.z = self.z or zlib.decompressobj(31)
            tail = self.z.unconsumed_tail
            if not tail:
                tail = self.data[self.pos : self.pos + self.STEP]
                self.pos += len(tail)
            self.held += self.z.decompress(tail, 4 * self.STEP)
            if self.z.eof:
                self.pos -= len(self.z.unused_data)
                self.z = None
        return len(self.held) - self.at >= need

    def skip(self, letters: bytes) -> None:
        """Go over any of these bytes."""
        while self.fill(1) and self.held[self.at] in letters:
            self.at += 1

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to the mark, which is gone over; None if there is no mark any more."""
        seen = 0
        while (end := self.held.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self.fill(seen + 1):
                return None
        out = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return out

    def take(self, n: int) -> bytes | None:
        if not self.fill(n):
            return None
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def parse(data: bytes):
    """The records of an archive: header fields and block, one at a time."""
    file = Unpacked(data)
    while True:
        file.skip(b"\r\n")
        if not file.fill(1):
            return
        head = file.until(b"\r\n\r\n")
        if head is None:
            raise ValueError("the archive ends inside a record's header")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = file.take(int(fields["content-length"]))
        if block is None:
            raise ValueError("the archive ends inside a record's block")
        yield fields, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in a folder. payload_bytes and payload_digest (bare base 32) are those of
    the payload where it is there, else those that the record states. block: of metadata records."""
    prepare(spark)  # a row is a file; a large one has a batch of its own

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        kinds = [pa.string()] * 7 + [pa.int64(), pa.int32(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows, size = [], 0
                for f, block in parse(data):
                    kind, payload, status, length = f.get("warc-type"), None, None, None
                    if kind in ("response", "revisit") and f.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        lines = head.decode("latin-1").split("\r\n")
                        status = int(lines[0].split(" ")[1]) if " " in lines[0] else None
                        length = next((int(x.partition(":")[2]) for x in lines[1:] if x.lower().startswith("content-length:")), None)
                    elif kind == "resource":
                        payload = block
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    if kind == "revisit":
                        payload = None
                    if payload is not None:
                        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    text = block.decode("utf-8", "replace") if kind == "metadata" else None
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), digest, length, status, text, payload if payloads else None))
                    size += len(payload or b"") * payloads + 500
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame, once: bool = True) -> DataFrame:
    """One row per response, revisit or resource: its fields, and the nested request and metadata records
    that are concurrent to it (null where there is none; of several the one of least record id).

    With `once`, a record that stands twice (the same id) counts once. Records without id, and those whose
    concurrent record is missing, belong to no capture. An empty archive gives no rows.
    """
    records = records.where("record_id is not null")
    main = records.where("type in ('response', 'revisit', 'resource')")
    main = main.dropDuplicates(["record_id"]) if once else main
    rest = records.where("type in ('request', 'metadata')")
    names = [c for c in records.columns if c != "payload"]
    named = rest.select(F.col("record_id").alias("id"), F.col("concurrent_to").alias("to")).where("to is not null")
    named = named.unionAll(main.where("concurrent_to is not null").select(F.col("concurrent_to").alias("id"), F.col("record_id").alias("to"))).distinct()
    direct = named.join(main.select(F.col("record_id").alias("to")).distinct(), "to").select("id", F.col("to").alias("capture"))
    through = named.join(direct.select(F.col("id").alias("to"), "capture"), "to").select("id", "capture")
    owner = direct.unionAll(through).groupBy("id").agg(F.min("capture").alias("capture"))
    part = lambda kind: F.min(F.when(F.col("type") == kind, F.struct(*names))).alias(kind)
    around = rest.join(owner.withColumnRenamed("id", "record_id"), "record_id").groupBy("capture").agg(part("request"), part("metadata"))
    return main.join(around.withColumnRenamed("capture", "record_id"), "record_id", "left")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to archives and back. Null html is empty. Rows that repeat a page_id and its html have records of
    the same ids, and each comes back; so do rows without page_id. An empty table gives no rows."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    records = written(read_archives(spark, path, payloads=False).drop("payload"), "records")
    found = captures(records, once=False)
    page = F.regexp_extract(F.col("metadata.block"), "(?m)^page-id: *(-?[0-9]*)", 1)
    found = found.select("record_id", F.nullif(page, F.lit("")).cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").alias("first"))
    found = written(found, "captures")
    firsts = found.where("record_type = 'response'").select(F.col("record_id").alias("first"), F.col("page_id").alias("refers_to")).distinct()
    return found.join(firsts, "first", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, unhex(sha1(html)) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, ('x' || sha1(html)) AS x FROM d),
e AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(x, 2 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)) AS digits FROM b)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(digits, '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM e
"""
