"""WARC archives: written as monolithic gzip streams, rewritten with a member for each record, read by an offset index.

Spark's text sink writes the records, one a row, with the record terminator as
line separator, so each part file is a WARC file in a single gzip member. The
normaliser takes such files (of any writer) as one stream each: Spark's text
reader inflates it once, a task puts the pieces between terminators together
again, cuts records by their Content-Length, writes each as a gzip member of
its own and a line of a sidecar index beside the archive. A task holds one
record at a time. Both files are written under a name of the attempt's own and
then renamed, the index last, so a repeated or lost task leaves the same files.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, key_of, lean

END = b"\r\n\r\n"
#: Payloads of fewer bytes are never told as copies.
LEAST_BYTES = 1000
#: Records of one monolithic file, at most.
FILE_RECORDS = 20_000
#: Archive bytes that one reading task takes.
READ_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string, error string"
RECORD = "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder or file that Spark names (file, hdfs, viewfs, s3a, gs, abfs; a bare path is local)."""
    if uri.startswith("s3a:"):
        uri = "s3" + uri[3:]
    if re.match(r"file:/(?!/)", uri):
        uri = uri[5:]
    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------------- writing
def records(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record): each row as the text of a WARC record without its terminator.

    Of equal payloads of ``LEAST_BYTES`` or more, the row with the largest id is a
    response and the others revisit it; all other rows are responses. Payloads
    are equal if SHA-1, MD5 and length are. A null payload is empty; a null id
    counts as the least and is left out of the record's name; rows that share
    the largest id and the payload are all responses. Line breaks in a url are
    percent-encoded, a null url has no header. Ids are integers; other columns
    are not read; an empty table gives no record.
    """
    payload = F.coalesce(column(payload_col).cast("binary"), F.lit(b""))
    url = F.replace(F.replace(column(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    plain = rows.select(key_of(id_col).alias("k"), url.alias("url"), payload.alias("p"))
    plain = plain.withColumns({"sha": F.sha1("p"), "md5": F.md5("p"), "n": F.octet_length("p").cast("long")})
    same = ["sha", "md5", "n"]
    owners = plain.where(F.col("n") >= LEAST_BYTES).groupBy(*same).agg(F.max("k").alias("owner"), F.min("k").alias("least")).where("least < owner").drop("least")
    told = plain.join(owners, same, "left").withColumn("again", F.coalesce(F.col("owner") > F.col("k"), F.lit(False)))
    # the payload's digest is part of the name, so that an id with two payloads has two records
    name = lambda k: F.concat(F.lit("<urn:page:"), F.when(F.col(k) != -(1 << 63), F.col(k).cast("string")).otherwise(""), F.lit(":"), F.col("sha"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("again"), 0).otherwise(F.col("n"))
    lines = [
        F.lit("WARC/1.1"), F.when(F.col("again"), "WARC-Type: revisit").otherwise("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), name("k")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha")),
        F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("owner"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("p").cast("string"))
    return told.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END.decode()), http, body).alias("record"))


def write_monolithic(found: DataFrame, folder: str) -> None:
    """Writes ``found(record)`` to ``folder`` as WARC files, each one gzip stream."""
    found.select("record").write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS).text(folder)


# --------------------------------------------------------------- normalising
def _headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


class _Cutter:
    """Cuts a stream of bytes into records: (headers, whole record or None, what is wrong)."""

    def __init__(self):
        self.held, self.head, self.need, self.lost = bytearray(), None, 0, False

    def feed(self, piece: bytes, last: bool = False) -> Iterator[tuple[dict, bytes | None, str | None]]:
        self.held += piece
        while True:
            if self.head is None:
                if len(self.held) >= 5 and not self.held.startswith(b"WARC/"):
                    at = self.held.find(b"\r\nWARC/")
                    gone = at + 2 if at >= 0 else len(self.held) if last else len(self.held) - 6  # what may begin a record stays
                    self.lost |= bool(self.held[: max(0, gone)].strip())
                    del self.held[: max(0, gone)]
                    if at < 0 and not last:
                        return
                    if self.lost:
                        yield {}, None, "bytes that belong to no record"
                    self.lost = False
                    continue
                at = self.held.find(END)
                if at < 0:
                    break
                self.head = _headers(bytes(self.held[:at]))
                size = self.head.get("content-length", "")
                if not re.fullmatch(r"[0-9]{1,18}", size):
                    yield self.head, None, "no Content-Length"
                    self.head = None
                    del self.held[: at + 4]
                    continue
                self.need = at + 4 + int(size)
            if len(self.held) < self.need + 4 and not (last and len(self.held) >= self.need):
                break
            yield self.head, bytes(self.held[: self.need]), None
            tail = 4 if self.held[self.need : self.need + 4] == END else 0
            del self.held[: self.need + tail]
            self.head = None
        if last:
            if self.held.strip() or self.head:
                yield self.head or {}, None, "record cut off"
            self.held, self.head = bytearray(), None


class _Archive:
    """One normalised archive and its sidecar, under names of this attempt until they are done."""

    def __init__(self, folder: str, source: str):
        self.fs, at = _filesystem(folder)
        self.fs.create_dir(at, recursive=True)
        stem = f"{hashlib.sha1(source.encode()).hexdigest()[:20]}.warc.gz"
        self.uri, self.path = f"{folder.rstrip('/')}/{stem}", posixpath.join(at, stem)
        task = TaskContext.get()
        self.draft = posixpath.join(at, f"_{stem}.{task.taskAttemptId() if task else 0}.{uuid.uuid4().hex}")
        self.out, self.index = self.fs.open_output_stream(self.draft, compression=None), self.fs.open_output_stream(f"{self.draft}.idx", compression=None)
        self.offset = self.count = self.wrong = 0

    def add(self, head: dict, record: bytes | None, error: str | None) -> None:
        length = 0
        if record is not None:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(record + END) + z.flush()
            self.out.write(member)
            length = len(member)
        line = {"archive": self.uri, "offset": self.offset, "length": length, "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "error": error}
        self.index.write(json.dumps(line).encode() + b"\n")
        self.offset += length
        self.count += 1
        self.wrong += error is not None

    def done(self) -> tuple[str, int, int, int]:
        self.out.close()
        self.index.close()
        for draft, path in ((self.draft, self.path), (f"{self.draft}.idx", f"{self.path}.idx")):
            if self.fs.type_name != "local" and self.fs.get_file_info(path).type != fs.FileType.NotFound:
                self.fs.delete_file(path)
            self.fs.move(draft, path)
        return self.uri, self.offset, self.count, self.wrong


def _normalise(folder: str):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, cutter, archive = None, None, None

        def done() -> pa.RecordBatch:
            for x in cutter.feed(b"", last=True):
                archive.add(*x)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(archive.done(), kinds, strict=True)], ["archive", "bytes", "records", "errors"])

        for batch in batches:
            for path, piece in zip(batch.column(0), batch.column(1), strict=True):
                path = path.as_py()
                if path != source:
                    if source is not None:
                        yield done()
                    source, cutter, archive = path, _Cutter(), _Archive(folder, path)
                for x in cutter.feed(piece.as_py() + END):
                    archive.add(*x)
        if source is not None:
            yield done()

    return run


def normalise(spark: SparkSession, source: str, folder: str) -> list:
    """Rewrites the WARC files of ``source`` to ``folder``, a gzip member a record, with ``*.idx`` sidecars.

    Returns (files, bytes, records, errors) as one row. Files named
    ``*.warc`` or ``*.gz`` are taken, also such as have members already. A record without a valid
    Content-Length, bytes between records and a last record cut off are
    skipped to the next ``WARC/`` line and stand in the index with ``error``.
    """
    system, at = _filesystem(folder)
    system.create_dir(at, recursive=True)
    pieces = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.{warc,gz}").text(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    done = pieces.mapInArrow(lean(_normalise(folder)), "archive string, bytes long, records long, errors long")
    return done.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"), F.sum("errors").alias("errors")).first()


# ------------------------------------------------------------------- reading
def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of ``folder``: where each record lies, and what was wrong with those that were skipped."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(END)
    named = _headers(head)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(END)
    kind = named.get("warc-type")
    if kind == "revisit":
        size = _headers(http).get("content-length", "")
        payload, n = None, int(size) if size.isdigit() else None
    else:
        payload = payload if http.startswith(b"HTTP/") else block
        n = len(payload)
    return named.get("warc-record-id"), named.get("warc-target-uri"), kind, named.get("warc-payload-digest"), n, named.get("warc-refers-to"), payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in RECORD.split(", ")], [*[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
    name, file = None, None
    try:
        for batch in batches:
            out, held = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    system, path = _filesystem(archive)
                    name, file = archive, system.open_input_file(path)
                out.append(_parse(zlib.decompress(file.read_at(length, offset), 31)))
                held += len(out[-1][-1] or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    finally:
        if file is not None:
            file.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of ``read_index`` name, each inflated alone; ``payload`` is null for revisits, whose size their HTTP header tells."""
    good = index.where("error is null").select("archive", "offset", "length")
    total = good.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    block = F.floor(F.col("offset") / READ_BYTES)
    placed = good.withColumn("block", block).repartition(total // READ_BYTES + 1, "archive", "block").sortWithinPartitions("archive", "offset")
    return placed.select("archive", "offset", "length").mapInArrow(lean(_read), RECORD)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
