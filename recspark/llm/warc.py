"""WARC archives: a writer with one gzip member per record, and a splittable reader.

A task of the reader takes a byte range of a file. It looks for gzip magic inside, accepts a candidate member only if its
first bytes decode to a WARC header, and owns the records that start inside its range; the last one may end behind it.
From an accepted member on, members follow each other without a search.

Defined results: a null html is an empty payload; a null url writes no target URI; pages with a null id are written with an
empty id and come back with null; pages that share an id keep a copy number each; an empty table writes no archive. Control
characters in a url are percent-encoded. A payload may be as long as a task's memory allows several times over.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recspark.session import work_path

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

READ = 1 << 20
NO_PAGE = -(1 << 63)  # stands for a null page id as a key
HEADER_LIMIT = 1 << 16
RECORD = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Rows to write: page_id, url, payload, digest, copy, is_revisit and the id of the first page with that payload.

    Payloads are dealt out once, by page id, for the join and the copy numbers alike; digests decide which pages share one.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "__key": F.coalesce("page_id", F.lit(NO_PAGE))})
    slim = rows.filter(F.length("payload") >= least_bytes).select("page_id", "digest")
    first = (
        slim.groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull(), "page_id")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", F.col("first.page_id").alias("first_id"))
    )
    shared = (
        slim.join(first, "digest")
        .groupBy(F.coalesce("page_id", F.lit(NO_PAGE)).alias("__key"))
        .agg(F.map_from_entries(F.collect_set(F.struct("digest", "first_id"))).alias("firsts"))
    )
    copies = Window.partitionBy("__key", "digest").orderBy("url")
    first_id = F.element_at("firsts", F.col("digest"))
    return (
        rows.join(shared, "__key", "left")
        .withColumn("copy", F.row_number().over(copies) - 1)
        .withColumn("is_shared", F.coalesce(F.array_contains(F.map_keys("firsts"), F.col("digest")), F.lit(False)))
        .withColumn("first_id", first_id)
        .withColumn("is_revisit", F.col("is_shared") & ~(F.col("page_id").eqNullSafe(first_id) & (F.col("copy") == 0)))
        .select("page_id", "copy", "url", "payload", "digest", "first_id", "is_revisit")
    )


def _record(page_id, copy, url, payload: bytes, digest: str, first_id, is_revisit: bool) -> bytes:
    name = "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}:{digest[:16]}:{copy}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        first = "" if first_id is None else first_id
        head += [f"WARC-Refers-To: <urn:page:{first}:{digest[:16]}:0>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store a task opens the path in, local, HDFS or an object store, and the path inside it."""
    uri = re.sub(r"^file:/+", "file:///", path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}"
    return pa.fs.FileSystem.from_uri(uri)


def write(rows: DataFrame, folder: str, level: int = 6) -> int:
    """Write rows of `with_revisits` as archives below `folder`, one per partition, and return the number of records.

    A task writes to a name of its own and renames at the end, so an attempt that is lost or repeated leaves no half file.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store_of(folder)
        part, out, count = TaskContext.get().partitionId(), None, 0
        trial = f"{root}/_trial-{uuid.uuid4().hex}"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(trial)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(_record(*row)) + packer.flush())
                count += 1
        if out is not None:
            out.close()
            files.move(trial, f"{root}/part-{part:05d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["records"])

    saved = rows.mapInArrow(save, "records long")
    return saved.agg(F.sum("records")).first()[0] or 0


def splits(spark: SparkSession, folder: str, split_bytes: int) -> DataFrame:
    """path, start, stop of the byte ranges of all archives below `folder`; the bytes themselves are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    starts = F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {split_bytes}L)"))
    return files.select("path", "length", starts.alias("start")).select(
        "path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop")
    )


def _header(data: bytes) -> bool:
    """Whether a gzip member that begins here decodes to the start of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(file, offset: int) -> tuple[bytes, int]:
    """The decoded member at `offset` and the offset behind it."""
    unpacker, parts, at = zlib.decompressobj(31), [], offset
    file.seek(offset)
    while not unpacker.eof:
        data = file.read(READ)
        if not data:
            raise ValueError(f"the gzip member at {offset} is cut short")
        at += len(data)
        parts.append(unpacker.decompress(data))
    return b"".join(parts), at - len(unpacker.unused_data)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(record: bytes) -> tuple:
    """type, id, target, refers-to, digest from the header, payload length, payload (None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    length = int(_fields(http).get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
    if not revisit and digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    return (
        fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
        digest, length, None if revisit else payload,
    )


def records_of(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records that start in [start, stop)."""
    at = start
    while at < stop:
        # Search: the next magic in the range whose member is a WARC record.
        file.seek(at)
        window = file.read(min(READ, stop - at) + HEADER_LIMIT)
        found = -1
        spot = window.find(MAGIC)
        while 0 <= spot < min(READ, stop - at):
            if _header(window[spot : spot + HEADER_LIMIT]):
                found = spot
                break
            spot = window.find(MAGIC, spot + 1)
        if found < 0:
            at += min(READ, stop - at)
            continue
        at += found
        # Walk: members follow each other; anything else between them starts a search again.
        while at < stop:
            file.seek(at)
            if not _header(file.read(HEADER_LIMIT)):
                at += 1
                break
            try:
                content, after = _member(file, at)
            except zlib.error:  # no member after all
                at += 1
                break
            yield at, content
            at = after


def read(spark: SparkSession, folder: str, split_bytes: int = 64 << 20) -> DataFrame:
    """All records of the archives below `folder`."""
    ranges = splits(spark, folder, split_bytes)
    names = [part.split(" ")[0] for part in RECORD.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                files, inner = store_of(path)
                out, held = [], 0
                with files.open_input_file(inner) as file:
                    for offset, content in records_of(file, start, stop):
                        out.append((path, offset, *parse(content)))
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return ranges.repartition("path", "start").mapInArrow(scan, RECORD)


def page_of(record_id: str) -> Column:
    """The page id inside a record id of the writer."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(-?[0-9]*):', 1) AS BIGINT)")


def archive(pages: DataFrame, level: int = 6, split_bytes: int = 64 << 20) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = work_path(spark, "warc")
    if not write(with_revisits(pages), folder, level):
        return spark.createDataFrame([], RECORD)
    return read(spark, folder, split_bytes)
