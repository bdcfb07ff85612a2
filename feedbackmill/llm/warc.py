"""WARC archives in ZIP packages: written by tasks, and read back record by record from byte ranges.

A package stores an archive of records, each compressed on its own, and an index with the place of
every record. Pages with equal payloads share one response record; the others revisit it.
"""

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.llm.common import slices
from feedbackmill.llm.token_files import _put
from feedbackmill.llm.zip_archive import member_start, read_directory, zip_stored
from feedbackmill.session import shared_dir, stage

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads from this size on are written once.
SHARED_BYTES = 1000
#: Tasks over which the copies of one payload are spread.
PARTS = 64
#: Compressed bytes after which a package ends, and bytes of records that one range read asks for.
PACKAGE_BYTES = 16 << 20
RANGE_BYTES = 2 << 20
_DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.rstrip(">").rsplit(":", 1)[1]
    return None if number == "null" else int(number)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit of the page ``refers_to`` whose block ends with the HTTP header."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """What a record says: page_id, url, record_type, refers_to, payload (None for revisits), size and digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    said = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(said["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    digest = base64.b32decode(said["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = said["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {said['warc-record-id']} doesn't match its digest")
    return {
        "page_id": _page(said["warc-record-id"]), "url": said.get("warc-target-uri"), "record_type": said["warc-type"],
        "refers_to": _page(said["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
        "payload_bytes": int(fields["content-length"]), "payload_digest": digest,
    }


def with_originals(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id with an equal payload, if that is another one.

    Payloads are compared by SHA-256; ids and digests alone are grouped. Payloads under
    ``SHARED_BYTES`` stand alone and stay where they lie; equal ones are spread over ``PARTS`` tasks.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    size = F.octet_length("html")
    small = rows.where(size < SHARED_BYTES).withColumn("refers_to", F.lit(None).cast("long"))
    large = rows.where(size >= SHARED_BYTES).withColumns({
        "same": F.sha2(F.col("html"), 256), "part": F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"),
    })
    # Counted by part first, so that a payload of a third of all pages meets in bounded rows.
    parts = large.groupBy("same", "part").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = parts.groupBy("same").agg(
        F.max("original").alias("original"), F.sum("n").alias("n"), F.collect_list("part").alias("parts")
    )
    # A row per part in which the payload occurs: copies of one payload stay spread over the parts.
    shared = groups.where("n > 1 and original is not null").select("same", F.explode("parts").alias("part"), "original")
    joined = large.join(shared, ["same", "part"], "left")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("original")), F.col("original"))
    return small.unionByName(joined.select("page_id", "url", "html", other.alias("refers_to")))


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page into packages in ``folder``; returns their names and sizes.

    Null html is an empty payload. Of equal large payloads the rows with the largest page_id are
    responses, also if that id is repeated; rows with a null id revisit it. A null url gives a record without
    target. Other columns are ignored. No pages give no package.
    """

    def write(batches):
        from pyspark import TaskContext

        # An attempt names its packages after itself: a repeated task may cut them elsewhere, and only
        # those of the attempt that Spark keeps are in the table of packages.
        part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        records, index, size = [], [], 0

        def flush():
            package = zip_stored([(ARCHIVE, b"".join(records)), (INDEX, "".join(index).encode())])
            name = f"part-{part:09d}-{number:06d}-{attempt}.wacz"
            _put(folder, name, package)
            return pa.RecordBatch.from_pydict({"name": [name], "bytes": [len(package)]})

        for batch in slices(batches, "html"):
            for key, link, text, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                record = gzip.compress(write_record(key, link, text.encode(), original), 6, mtime=0)
                index.append(json.dumps({"page": key, "offset": size, "length": len(record)}) + "\n")
                records.append(record)
                size += len(record)
                if size >= PACKAGE_BYTES:
                    yield flush()
                    records, index, size, number = [], [], 0, number + 1
        if records:
            yield flush()

    rows = with_originals(pages, page_id, url, html)
    return stage(rows.mapInArrow(write, "name string, bytes long"), "packages")


def _opened(folder: str, name: str):
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    file = files.open_input_file(f"{root}/{name}")

    def read(start: int, end: int) -> bytes:
        return file.read_at(end - start, start)

    return file, read


def read_packages(folder: str, packages: DataFrame) -> DataFrame:
    """All records of the named packages: page_id, url, record_type, refers_to, html, payload_bytes, payload_digest.

    One task reads a package's directories and index, and hands out ranges of neighbouring records;
    others read those ranges. html is null in revisits. Damaged records fail.
    """

    def ranges(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                file, read = _opened(folder, name)
                with file:
                    members = {m.name: m for m in read_directory(read, file.size())}
                    first, start = (member_start(read, members[m]) for m in (ARCHIVE, INDEX))
                    index = read(start, start + members[INDEX].size).decode().splitlines()
                lengths, begin, total = [], 0, 0
                for at, line in enumerate(index):
                    entry = json.loads(line)
                    if not lengths:
                        begin = first + entry["offset"]
                    lengths.append(entry["length"])
                    total += entry["length"]
                    if total >= RANGE_BYTES or at == len(index) - 1:
                        yield pa.RecordBatch.from_pydict({"name": [name], "begin": [begin], "lengths": pa.array([lengths], pa.list_(pa.int64()))})
                        lengths, total = [], 0

    schema = "page_id long, url string, record_type string, refers_to long, html string, payload_bytes long, payload_digest string"
    kinds = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])

    def records(batches):
        for batch in batches:
            for name, begin, lengths in zip(*(batch.column(c).to_pylist() for c in ("name", "begin", "lengths")), strict=True):
                file, read = _opened(folder, name)
                with file:
                    raw, at, rows = read(begin, begin + sum(lengths)), 0, []
                for length in lengths:
                    row = read_record(zlib.decompress(raw[at : at + length], 31))
                    payload = row.pop("payload")
                    rows.append(row | {"html": None if payload is None else payload.decode()})
                    at += length
                yield pa.RecordBatch.from_pylist(rows, kinds)

    blocks = packages.select("name").mapInArrow(ranges, "name string, begin long, lengths array<long>")
    parts = packages.sparkSession.sparkContext.defaultParallelism * 4
    return blocks.repartition(parts, "name", "begin").mapInArrow(records, schema)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to packages in the shared folder and read them back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_packages(folder, write_packages(pages, folder))
