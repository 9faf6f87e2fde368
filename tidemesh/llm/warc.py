"""Operator 12: WARC archives, written, read and assembled to captures.

`write` turns each page into a transaction of three records: a request, a response or revisit, and a metadata record,
the other two concurrent to the main one.  Of rows with equal payloads (SHA-1 and SHA-256 together) the one with the
smallest page id is the response, and the others are revisits that refer to it and hold no payload again.  Spark's text
writer writes the archives: a row is a record, and the line separator is the end that WARC gives to a record.  So a lost
task leaves nothing behind.  Each file is one gzip stream.

`read` takes archives, plain or gzip (also one stream a record), of any writer: records are found by their lengths, never
by searching for a boundary, and a file is unpacked piece by piece.  `assemble` joins the records of a transaction through
their concurrent-to identifiers: from the main record, to it, or through one record between.  `resolve` gives revisits the
payload facts of the response they refer to.

Bounds: a file has about `file_bytes` of records; an executor holds one archive as it lies on disk, and the records at
hand.  The members of one capture are gathered in its row.  A payload that a third of all pages share is written once, its
revisits are rows without payload, and the joins to it can be split.

Defined results: a null payload is empty; null ids count as larger than all others and come back as null; equal rows are
captures of their own, one of them the response; a null url has no target header and control characters and blanks in one
are percent-encoded, as an URI demands; payloads may hold any bytes, also ends of records; empty tables give archives
without records; other columns, whatever their names, are not read.  A record that is cut off, or that does not begin as a
record, raises an error with the file's name.  Records without a main record come as a capture of their own whose main
record is null, so none is lost; a record id that occurs twice counts once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch, shared_dir

#: What base32 writes for 0 to 31, and the profile of a revisit with an equal payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
MAIN = ("response", "revisit", "resource", "conversion")


def base32(hex_digits: Column) -> Column:
    """Of 40 hexadecimal digits: ten at a time are eight digits to the base 32, whose own letters are then put in."""
    eight = lambda k: F.lpad(F.conv(F.substring(hex_digits, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[eight(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _facts(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    data = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("data"))
    return rows.select("page_id", "url", F.sha1("data").alias("sha1"), F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("bytes"), "data")


def decided(facts: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits) of saved rows without payloads; `first` is the row that a revisit refers to."""
    key = ["sha1", "sha256"]
    large = facts.where(F.col("bytes") >= least_bytes)
    first = large.groupBy(*key).agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")).alias("f"), F.min_by(F.struct("url", "bytes"), F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("x"))
    first = first.select(*key, F.col("f.row").alias("row"), F.col("f.page_id").alias("page_id"), F.col("x.url").alias("url"), F.col("x.bytes").alias("bytes"))
    responses = first.unionByName(facts.where(F.col("bytes") < least_bytes).select(*first.columns))
    revisits = large.join(first.select(*key, F.col("row").alias("first"), F.col("url").alias("first_url")), key).where("row <> first")
    return responses, revisits


def _record(headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without its end; headers whose value is null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, size, block)


def _named(run: str, row: Column, what: str) -> Column:
    h = F.md5(F.concat(F.lit(f"{run}/{what}/"), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if k > 1 else ""), F.substring(h, k, n))], F.lit(">"))


def _encoded(url: Column) -> Column:
    out = url
    for code in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives of all rows in a new folder."""
    run = uuid.uuid4().hex
    with scratch():
        pairs = _facts(pages, id_col, url_col, payload_col)
        rows = saved(pairs.drop("data").withColumn("row", F.monotonically_increasing_id()))
        n, size = rows.agg(F.count("*"), F.coalesce(F.avg("bytes"), F.lit(0.0))).first()
        responses, revisits = decided(rows, least_bytes)
        data = pairs.select("sha1", "sha256", "data").dropDuplicates(["sha1", "sha256"])
        stored = responses.join(data, ["sha1", "sha256"]).select("row", "page_id", "url", "sha1", "bytes", F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_url"), F.col("data").cast("string").alias("data"))
        again = revisits.select("row", "page_id", "url", "sha1", "bytes", "first", "first_url", F.lit("").alias("data"))
        # what records share is worked out once a row
        rows = stored.unionByName(again).select(
            "row", "page_id", "bytes", "first", "data", _encoded(F.col("url")).alias("url"), _encoded(F.col("first_url")).alias("first_url"), F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("digest"), _named(run, F.col("row"), "main").alias("main"),
            F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        )
        url, date, main, first_url, revisit = F.col("url"), F.col("date"), F.col("main"), F.col("first_url"), F.col("first").isNotNull()
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END), F.col("data"))
        host = F.regexp_extract(url, r"://([^/?#]*)", 1)
        target = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
        asks = F.concat(F.lit("GET "), F.coalesce(F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
        known = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
        kind = F.when(revisit, "revisit").otherwise("response")
        records = F.array(
            _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _named(run, F.col("row"), "request")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))], asks),
            _record([("WARC-Type", kind), ("WARC-Record-ID", main), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.col("digest")), ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, _named(run, F.col("first"), "main"))), ("WARC-Refers-To-Target-URI", F.when(revisit, first_url)), ("Content-Type", F.lit("application/http; msgtype=response"))], http),
            _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _named(run, F.col("row"), "metadata")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], known),
        )
        most = max(3, int(3 * file_bytes / (size + 1200)))
        rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class _Stream:
    """The bytes of an archive, unpacked as they are asked for."""

    def __init__(self, data: bytes, name: str, step: int = 1 << 20):
        self.name, self.data, self.at, self.step, self.have, self.place = name, memoryview(data), 0, step, bytearray(), 0
        self.packed = bytes(self.data[:2]) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        del self.have[: self.place]
        self.place = 0
        if self.at >= len(self.data):
            if self.packed and not self.inflate.eof:
                raise ValueError(f"{self.name}: the gzip stream is cut off")
            return False
        piece = self.data[self.at : self.at + self.step]
        self.at += len(piece)
        while len(piece) and self.packed:
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.have += self.inflate.decompress(piece)
            piece = self.inflate.unused_data
        self.have += piece
        return True

    def take(self, n: int) -> bytes:
        while len(self.have) - self.place < n:
            if not self.more():
                raise ValueError(f"{self.name}: a record is cut off")
        self.place += n
        return bytes(memoryview(self.have)[self.place - n : self.place])

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end of the archive."""
        seen = 0
        while (end := self.have.find(b"\n", self.place + seen)) < 0:
            seen = max(0, len(self.have) - self.place)
            if not self.more():
                if self.have:
                    raise ValueError(f"{self.name}: a header is cut off")
                return None
        out = bytes(memoryview(self.have)[self.place : end])
        self.place = end + 1
        return out.removesuffix(b"\r")


def fields_of(lines) -> list[tuple[str, str]]:
    """(name in lower case, value) of header lines; a line that begins with a blank goes on with the one before it."""
    out: list[list[str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if out and text[:1] in (" ", "\t"):
            out[-1][1] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append([name.strip().lower(), value.strip()])
    return [(a, b) for a, b in out]


def records_of(data: bytes, name: str = ""):
    """(headers, block) of every record of an archive."""
    stream = _Stream(data, name)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record begins with {line[:40]!r}")
        lines = []
        while line := stream.line():
            lines.append(line)
        if line is None:
            raise ValueError(f"{name}: a header is cut off")
        headers = fields_of(lines)
        length = dict(headers).get("content-length", "")
        if not length.isdecimal():
            raise ValueError(f"{name}: a record has no length")
        yield headers, stream.take(int(length))


_SCHEMA = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, digest string, bytes long, fields map<string,string>, payload binary"


def _row(headers: list[tuple[str, str]], block: bytes, payload: bool) -> tuple:
    one = dict(reversed(headers))
    kind = one.get("warc-type", "").lower()
    fields: list[tuple[str, str]] = []
    body, stated = block, one.get("warc-payload-digest", "")
    if one.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head = re.search(rb"\r?\n\r?\n", block)
        body = block[head.end() :] if head else b""
        fields = fields_of(re.split(rb"\r?\n", block[: head.start() if head else len(block)])[1:])
    elif "warc-fields" in one.get("content-type", ""):
        fields = fields_of(re.split(rb"\r?\n", block))
    if kind == "revisit":
        digest, size = stated.split(":", 1)[-1].upper() or None, None
    else:
        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
    linked = [v for k, v in headers if k == "warc-concurrent-to"]
    return one.get("warc-record-id"), kind, one.get("warc-target-uri"), one.get("warc-date"), linked, one.get("warc-refers-to"), digest, size, list(dict(fields).items()), body if payload and kind != "revisit" else None


def read(spark: SparkSession, path: str, payload: bool = True, suffixes: str = "*") -> DataFrame:
    """(record_id, type, target_uri, date, concurrent_to, refers_to, digest, bytes, fields, payload) of every record.

    digest and bytes are those of the payload as it was read; of a revisit, the stated digest.  fields are the headers of
    an HTTP block or the lines of a fields block.  Without `payload` that column is null and no payload leaves its task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(path).select("path", "content")
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", _SCHEMA)]

    def run(batches):
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                rows, held = [], 0
                for headers, block in records_of(batch.column(1)[k].as_buffer(), name):
                    rows.append(_row(headers, block, payload))
                    held += 1000 + (len(block) if payload else 0)
                    if held > 8 << 20:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return files.mapInArrow(run, _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, main, requests, metadata, others): one nested row a capture.  main is a struct with the record's
    columns; the others are arrays of structs, sorted by record id."""
    records = records.dropDuplicates(["record_id"])
    is_main = F.col("type").isin(*MAIN)
    ends = saved(records.select(F.col("record_id").alias("a"), is_main.alias("main"), F.explode("concurrent_to").alias("b")))
    mains, members = records.where(is_main), records.where(~is_main)
    own = saved(members.select(F.col("record_id").alias("a")))
    named = mains.select(F.col("record_id").alias("b"))
    # a member that names its main record, or that a main record names
    near = ends.where("not main").select("a", "b").join(named, "b").unionByName(ends.where("main").select(F.col("b").alias("a"), F.col("a").alias("b")).join(own, "a"))
    near = saved(near.groupBy("a").agg(F.min("b").alias("main")))
    # a member that such a member names, or that names one
    links = ends.where("not main").select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(own, "a").join(near, "a", "left_anti").join(near.select(F.col("a").alias("b"), "main"), "b").groupBy("a").agg(F.min("main").alias("main"))
    at = near.unionByName(far)
    row = F.struct(*records.columns)
    kept = members.join(at.withColumnRenamed("a", "record_id"), "record_id", "left").select(F.coalesce("main", "record_id").alias("capture_id"), "type", row.alias("r"))
    of = lambda *kinds: F.sort_array(F.collect_list(F.when(F.col("type").isin(*kinds), _plain(F.col("r")))))
    rest = F.sort_array(F.collect_list(F.when(~F.col("type").isin("request", "metadata"), _plain(F.col("r")))))
    gathered = kept.groupBy("capture_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"), rest.alias("others"))
    return mains.select(F.col("record_id").alias("capture_id"), row.alias("main")).join(gathered, "capture_id", "full_outer")


def _plain(r: Column) -> Column:
    """A record as a struct that can be sorted: its fields as entries in the place of a map."""
    names = ["record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "digest", "bytes"]
    return F.struct(*[r[n].alias(n) for n in names], F.map_entries(r["fields"]).alias("fields"), r["payload"].alias("payload"))


def field(entries: Column, name: str) -> Column:
    """The value of a field in the entries of a record."""
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def resolve(captures: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every capture with a main record.

    A revisit takes size and digest from the response it refers to, as read there; where the archives do not hold that one,
    the size is null and the digest the stated one."""
    page = field(F.get("metadata", F.lit(0))["fields"], "page-id").cast("long")
    rows = saved(captures.where("main is not null").select("capture_id", page.alias("page_id"), F.col("main.target_uri").alias("url"), F.col("main.bytes").alias("bytes"), F.col("main.digest").alias("digest"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to")))
    first = rows.where("record_type <> 'revisit'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("first"), F.col("bytes").alias("b"), F.col("digest").alias("d"))
    again = rows.where("record_type = 'revisit'").join(first, "to", "left").select("page_id", "url", F.col("b").alias("payload_bytes"), F.coalesce("d", "digest").alias("payload_digest"), "record_type", F.col("first").alias("refers_to"))
    own = rows.where("record_type <> 'revisit'").select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What `resolve` says of the pages, written to archives in the shared folder and read back from them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    with scratch() as tables:
        out = tables.keep(saved(resolve(assemble(saved(read(spark, path, payload=False))))))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM f
"""
