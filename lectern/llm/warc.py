"""Pages as WARC archives of gzip members, written in parallel and read back by byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, cut_told, shared_dir, slices

# The first bytes of a gzip member, and the formats' fields.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPE, RECORD, DATE, TARGET, CONTENT, LENGTH, DIGEST, REFERS = "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type", "Content-Length", "WARC-Payload-Digest", "WARC-Refers-To"
#: Fields of our own, which readers of the format pass over.
PAGE, REFERS_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"

#: Payloads shorter than this are never written as a reference to another.
LEAST_REVISIT = 100
#: Bytes of an archive after which a task begins another, and of a range that one task reads.
ARCHIVE_BYTES, RANGE_BYTES = 1 << 30, 32 << 20
#: Bytes that are read from a file at once, and that are decoded at once.
READ_BYTES, INFLATE_BYTES = 1 << 20, 4 << 20

INDEX = "file string, range_start long, offset long, length long, record_type string, record_id string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, sound boolean"


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return FileSystem.from_uri(path)


# Which records are written whole


def judged(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to, and a record_id.

    Of equal payloads of at least LEAST_REVISIT bytes the row with the smallest
    page_id is the response, the others revisit it; of rows that repeat this id
    too, the first as stored. A null id comes after all others. Only payloads
    found more than once are joined back, and only by their digest.
    """
    at = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("file"), F.col("row"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    ).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256), "at": at})
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    # written, so that its size is known: where it is small, as most often, it is broadcast and no page is shuffled
    often = cut(large.groupBy("payload_digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first"))
    known = rows.join(often, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("at") != F.col("first"))

    def urn(row: Column) -> Column:
        # named by the row's place; sha2 in place of a random id, so that a repeated task writes the same
        return F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", row["file"], row["row"].cast("string")), 256), F.lit(">"))

    return known.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), urn(F.col("at")).alias("record_id"), F.when(revisit, urn(F.col("first"))).alias("refers_record"),
    )


# Writing


def block(fields: dict[str, object]) -> bytes:
    """Header lines of the fields that are there; line ends inside a value become spaces."""
    return b"".join(f"{k}: {' '.join(str(v).splitlines())}\r\n".encode() for k, v in fields.items() if v is not None)


def record(row: dict, date: str) -> bytes:
    """A page as one record: an HTTP response with the page, or without it where another record has it."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["html"]
    http = b"HTTP/1.1 200 OK\r\n" + block({CONTENT: "text/html; charset=utf-8", LENGTH: row["payload_bytes"]}) + b"\r\n"
    fields = {
        TYPE: row["record_type"], RECORD: row["record_id"], DATE: date, TARGET: row["url"], PAGE: row["page_id"], DIGEST: "sha256:" + row["payload_digest"],
        "WARC-Profile": PROFILE if revisit else None, REFERS: row["refers_record"], REFERS_PAGE: row["refers_to"], CONTENT: "application/http; msgtype=response", LENGTH: len(http) + len(payload),
    }
    return VERSION + b"\r\n" + block(fields) + b"\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write judged() pages as archives under path, a gzip member for each record; (file, bytes, records) of the archives.

    Every attempt of a task writes files of its own name, and the table returned
    holds those of the attempts that ended well: what lost executors leave is
    named nowhere. path is on a file system that Arrow reaches (local, HDFS, S3,
    GCS, Azure) and that all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, name, size, count, done = TaskContext.get(), None, "", 0, 0, []
        fs, root = opened(path)
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"part-{task.partitionId():05d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data := member(record(row, date)))
                size, count = size + len(data), count + 1
                if size >= most:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        names, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["file", "bytes", "records"])

    return cut(pages.mapInArrow(write, "file string, bytes long, records long"))


# Reading


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the archives under a path or glob, as Spark lists them; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class Bytes:
    """A file's bytes by position, through one buffer that moves on."""

    def __init__(self, path: str):
        fs, inner = opened(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.start, self.data = 0, b""

    def load(self, at: int, least: int = 1) -> memoryview:
        """What the buffer holds from `at` on, at least so many bytes unless the file ends."""
        if not self.start <= at <= self.start + len(self.data) - min(least, self.size - at):
            self.start, self.data = at, self.file.read_at(max(0, min(max(READ_BYTES, least), self.size - at)), at)
        return memoryview(self.data)[at - self.start :]

    def find(self, at: int, end: int) -> int | None:
        """The first place of MAGIC that begins in [at, end)."""
        while at < end:
            held = self.load(at, len(MAGIC))
            found = self.data.find(MAGIC, at - self.start)
            if found >= 0:
                return self.start + found if self.start + found < end else None
            at += max(1, len(held) - len(MAGIC) + 1)
        return None


def fields_of(lines: bytes) -> dict[str, str]:
    """Header lines by their names in lower case; a line that begins with a space goes on with the one before."""
    found: dict[str, str] = {}
    last = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            found[last := name.strip().lower()] = value.strip()
    return found


def whole(value: str | None) -> int | None:
    return int(value) if value and value.strip().lstrip("-").isdigit() else None


def read_member(source: Bytes, at: int, keep: bool = False) -> tuple[dict, int, bytes] | None:
    """The record of the gzip member that begins at a place, where it ends, and its payload if wanted; None if there is no record.

    A candidate counts if its gzip header and first bytes decode, they are a WARC
    header with a length, the member ends with the right checksum, and what it
    holds is as long as its header says. The payload is hashed as it is decoded
    and held only where it is wanted.
    """
    inflate, place, chunk, head = zlib.decompressobj(31), at, b"", b""
    fields: dict[str, str] | None = None
    http, left, want, total, size, digest, kept = b"", 0, 0, 0, 0, hashlib.sha256(), []
    is_http = in_payload = False
    try:
        while not inflate.eof:
            if not chunk:
                chunk = source.load(place)
                place += len(chunk)
                if not chunk:
                    return None
            data = inflate.decompress(chunk, INFLATE_BYTES)
            chunk = inflate.unconsumed_tail
            if fields is None:
                head += data
                if not head.startswith(b"WARC/"[: len(head)]):
                    return None
                stop = head.find(b"\r\n\r\n")
                if stop < 0:
                    continue
                fields = fields_of(head[:stop])
                if (told := whole(fields.get(LENGTH.lower()))) is None or told < 0:
                    return None
                want = left = told
                data, head = head[stop + 4 :], b""
                is_http = fields.get(CONTENT.lower(), "").startswith("application/http")
                in_payload = not is_http
            total += len(data)
            body, left = data[:left], max(0, left - len(data))
            if not in_payload:
                http += body
                stop = http.find(b"\r\n\r\n")
                if stop < 0:
                    continue
                body, in_payload, http = http[stop + 4 :], True, http[:stop]
            digest.update(body)
            size += len(body)
            if keep:
                kept.append(body)
    except zlib.error:
        return None
    if fields is None or not want <= total <= want + 4:  # two line ends follow
        return None
    place -= len(inflate.unused_data)
    kind, told = fields.get(TYPE.lower()), fields.get(DIGEST.lower(), "")
    given = told.partition(":")[2].lower() if told.lower().startswith("sha256:") else None
    found = digest.hexdigest()
    revisit = kind == "revisit"
    if revisit:  # its payload is elsewhere; what it says of it counts
        size = whole(fields_of(http).get(LENGTH.lower()))
    out = {
        "record_type": kind, "record_id": fields.get(RECORD.lower()), "page_id": whole(fields.get(PAGE.lower())), "refers_to": whole(fields.get(REFERS_PAGE.lower())), "url": fields.get(TARGET.lower()),
        "payload_bytes": size, "payload_digest": given if revisit else found, "sound": revisit or given is None or given == found,
    }
    return out, place, b"".join(kept)


def records_in(path: str, start: int, end: int) -> Iterator[dict]:
    """The records that begin in a range of bytes, each read to its end wherever that is."""
    source, at = Bytes(path), start
    while (found := source.find(at, min(end, source.size))) is not None:
        if (got := read_member(source, found)) is None:
            at = found + 1  # the three bytes stand there by chance
            continue
        out, at, _ = got
        yield out | {"file": path, "range_start": start, "offset": found, "length": at - found}


def index_warc(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """A row for each record of archives (file, bytes): where it lies, and its header's and payload's data.

    Files are dealt out by ranges of `step` bytes. A task looks for the first
    bytes of gzip members, takes those that decode to a record, and owns the
    records that begin in its range. A member that lies within another's bytes (an
    archive stored as a page) decodes too; where a range begins inside such a
    record, its task can't know. So ranges tell how far their records reach, and
    what begins before the end of a record of an earlier range is no record. An
    archive cut off in the middle gives the records before.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in INDEX.split(", ")])
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[dict] = []
                for found in records_in(row["file"], row["start"], row["end"]):
                    rows.append(found)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema).select(names)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema).select(names)

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step).cast("long"))
    ranges, told = cut_told(files.where("bytes > 0").select("file", F.explode(starts).alias("start"), "bytes"), n=F.count(F.lit(1)))
    spread = ranges.select("file", "start", F.least(F.col("start") + step, F.col("bytes")).alias("end")).repartition(max(1, min(told["n"], 100_000)))
    found = cut(spread.mapInArrow(read, INDEX))
    reach = found.groupBy("file", "range_start").agg(F.max(F.col("offset") + F.col("length")).alias("reach"))
    before = F.max("reach").over(Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1))
    known = found.join(reach.select("file", "range_start", F.coalesce(before, F.lit(0)).alias("taken")), ["file", "range_start"])
    return known.where("offset >= taken").drop("taken", "range_start")


def fetch(index: DataFrame) -> DataFrame:
    """index rows with `payload`: the bytes of each record, read at its place; a revisit's are null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, payloads = batch.slice(at, 64), []
                for file, offset, kind in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "record_type")), strict=True):
                    if file != name:
                        source, name = Bytes(file), file
                    payloads.append(None if kind == "revisit" else read_member(source, offset, keep=True)[2])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary())], [*part.schema.names, "payload"])

    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)
    return index.sortWithinPartitions("file", "offset").mapInArrow(read, f"{schema}, payload binary")


def with_revisited(fetched: DataFrame) -> DataFrame:
    """fetched rows where revisits have the payload of the response with their digest."""
    held = fetched.where("record_type = 'response'").groupBy("payload_digest").agg(F.min_by("payload", "offset").alias("held"))
    known = fetched.join(held, "payload_digest", "left")
    return known.withColumn("payload", F.coalesce("payload", "held")).drop("held")


def stored(pages: DataFrame) -> DataFrame:
    """pages as a table of files, whose rows have a place of their own."""
    try:
        pages.select("_metadata.row_index")
    except Exception as e:
        if "_metadata" not in str(e):
            raise
        return cut(pages)
    return pages


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html), from its record as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, and more.

    A null html is an empty payload; empty and short payloads are written whole
    each time. A null page_id is kept, comes after all others, and is null again
    where others refer to it. Repeated rows are records of their own: one is the
    response. A null url is left out. Other columns are not read. No pages make no
    archive and no rows.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = write_warc(judged(stored(pages)), path)
    return index_warc(files)
