"""Operator 3: WARC archives and the normaliser of monolithic gzip files.

Pages are written as WARC records by Spark's own text writer with gzip, which makes
each part file one gzip stream over all its records: a monolithic archive. The
normaliser inflates such a file once, as a stream, rewrites every record as a gzip
member of its own and writes a sidecar index (one JSON line a record: archive,
offset, length, id, type). Archives are read back through the index: Spark deals out
its rows, and a task reads and inflates just the members it was dealt.

Of records with equal payloads (of ``min_bytes`` or more) the one with the smallest
page id is a ``response``, the others are ``revisit`` records that refer to it and
carry only its headers. Payload digests are counted map-side; only digests that occur
twice or more are joined back, and the join splits a digest that very many pages
have.

Files go to the shared folder of ``spark.checkpoint.dir``. A task writes under a
name of its own and renames when it is done, so a repeated task leaves the same
files. Memory is one record and a chunk of the stream.

A null html is an empty payload. Rows that repeat the smallest page id of their
payload are responses each. A null page id is larger than any other: it is a revisit
where another page has the payload, and else a response, and comes back null. Line
breaks in a URL are dropped from its header, and extra columns are not carried. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.session import checkpoint_dir

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
CHUNK = 1 << 20
INDEX = "archive string, offset bigint, length bigint, id string, type string"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits at a time are four letters."""
    def letters(hexed: Column) -> Column:
        parts = []
        for i in range(8):
            bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
            parts += [F.substr(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                      for s in (15, 10, 5, 0)]
        return F.concat(*parts)
    return letters(F.sha1(value))


def with_originals(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url",
                   min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest`` and ``first``, the page that the record
    refers to (null for responses)."""
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"),
                       F.coalesce(F.col(html), F.lit("")).alias("payload"))
    own = own.withColumn("digest", base32_sha1(F.col("payload")))
    often = own.where(F.octet_length("payload") >= min_bytes).groupBy("digest") \
        .agg(F.count("*").alias("n"), F.min("page_id").alias("least")).where("n > 1").drop("n")
    return own.join(often, "digest", "left").withColumn(
        "first", F.when(~F.col("least").eqNullSafe(F.col("page_id")), F.col("least"))).drop("least")


def _record(date: str) -> Column:
    """WARC record without the blank lines that end it."""
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    size, F.lit(CRLF * 2))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate(F.coalesce("url", F.lit("")), "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", name(F.col("first"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block)


def write_monolithic(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", **names) -> None:
    """One gzip stream of records a partition."""
    with_originals(pages, **names).select(_record(date).alias("record")) \
        .write.mode("overwrite").option("compression", "gzip").option("lineSep", CRLF * 2).text(folder)


def _open(uri: str):
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def inflated(source, chunk: int = CHUNK):
    """Chunks of the inflated stream of a gzip file of one or more members."""
    inflate = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            yield inflate.decompress(data, 4 * chunk)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


def records(chunks):
    """Whole records (headers, block and the blank lines behind it) of a stream."""
    buffer = bytearray()
    chunks = iter(chunks)

    def until(enough) -> int:
        while (n := enough()) < 0:
            more = next(chunks, None)
            if more is None:
                return -1
            buffer.extend(more)
        return n

    while True:
        head = until(lambda: buffer.find(b"\r\n\r\n"))
        if head < 0:
            if buffer.strip():
                raise ValueError("the stream ends inside a record's headers")
            return
        size = int(headers(bytes(buffer[:head])).get("content-length", "0"))
        end = head + 4 + size + 4
        if until(lambda: end if len(buffer) >= end else -1) < 0:
            raise ValueError("the stream ends inside a record")
        yield bytes(buffer[:end])
        del buffer[:end]


def headers(data: bytes) -> dict[str, str]:
    """Header lines behind the first line, by lower-case name."""
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def normalise_file(source: str, folder: str, level: int = 6) -> tuple[str, int]:
    """Rewrites one monolithic file; the archive's place and its number of records."""
    files, path = _open(source)
    out, base = _open(folder)
    stem = path.rsplit("/", 1)[-1].split(".")[0]
    own = uuid.uuid4().hex
    archive, index = f"{base}/{stem}.warc.gz", f"{base}/{stem}.index.json"
    n = offset = 0
    with files.open_input_stream(path, compression=None) as stream, \
            out.open_output_stream(f"{base}/_{own}.gz", compression=None) as target, \
            out.open_output_stream(f"{base}/_{own}.json", compression=None) as listing:
        for record in records(inflated(stream)):
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = deflate.compress(record) + deflate.flush()
            head = headers(record[:record.find(b"\r\n\r\n")])
            line = {"archive": f"{folder}/{stem}.warc.gz", "offset": offset, "length": len(member),
                    "id": head.get("warc-record-id"), "type": head.get("warc-type")}
            listing.write(json.dumps(line).encode() + b"\n")
            target.write(member)
            offset += len(member)
            n += 1
    out.move(f"{base}/_{own}.gz", archive)
    out.move(f"{base}/_{own}.json", index)
    return f"{folder}/{stem}.warc.gz", n


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Normalises every ``.gz`` file of a folder, a task each at most, and returns the
    records' index."""
    _mkdir(target)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")

    def work(batches):
        for batch in batches:
            done = [normalise_file(p, target) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.string()),
                                              pa.array([n for _, n in done], pa.int64())], names=["archive", "n"])

    # archives are numbered, so that each has a task of its own (a hash of the path collides)
    numbered = found.withColumn("n", F.row_number().over(Window.orderBy("path")) - 1)       # a row an archive
    paths = numbered.repartitionById(max(1, found.count()), F.col("n")).select("path")
    paths.mapInArrow(work, "archive string, n bigint").agg(F.sum("n")).collect()
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(target)


def _mkdir(folder: str) -> None:
    files, path = _open(folder)
    files.create_dir(path, recursive=True)


def _page(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _read(batches):
    """Reads the members that index rows name."""
    handles: dict = {}
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if archive not in handles:
                files, path = _open(archive)
                handles = {archive: files.open_input_file(path)}
            handle = handles[archive]
            handle.seek(offset)
            record = zlib.decompress(handle.read(length), 31)
            top = record.find(b"\r\n\r\n")
            head = headers(record[:top])
            block = record[top + 4:top + 4 + int(head["content-length"])]
            body = block.find(b"\r\n\r\n") + 4
            revisit = head["warc-type"] == "revisit"
            if revisit:
                size = int(headers(block[:body - 4])["content-length"])
                digest = head["warc-payload-digest"].partition(":")[2]
            else:
                size = len(block) - body
                digest = base64.b32encode(hashlib.sha1(block[body:]).digest()).decode()
            row = (_page(head["warc-record-id"]), size, digest, head["warc-type"],
                   _page(head["warc-refers-to"]) if revisit else None)
            for column, value in zip(out, row):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def read_archives(index: DataFrame) -> DataFrame:
    """One row a record of the archives of an index."""
    return index.select("archive", "offset", "length").mapInArrow(_read, RESULT)


def warc_round_trip(pages: DataFrame, folder: str | None = None, key: str = "page_id", html: str = "html",
                    url: str = "url", min_bytes: int = 0) -> DataFrame:
    """Writes monolithic archives of the pages, normalises them, and reads them back:
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    spark = pages.sparkSession
    if folder is None:
        checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_monolithic(pages, f"{folder}/monolithic", key=key, html=html, url=url, min_bytes=min_bytes)
    return read_archives(normalise(spark, f"{folder}/monolithic", f"{folder}/archives"))
