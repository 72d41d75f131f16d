"""WARC archives: write records with an index, then read selected records by coalesced byte ranges.

Every record is its own gzip member (ISO 28500), so it can be read alone. A task writes its records
to archive files of a bounded size, under names that no other attempt uses, and returns one index
row per record: file, offset, length, URL and payload digest. The index is written by Spark, which
keeps the rows of one attempt per task; files of an attempt that was lost have no index rows and are
never read.

Reading begins with the index. Selected rows are sorted by file and offset; neighbouring ranges whose
gap is small are fetched with one read, and each member is unpacked and parsed. A response's payload
must have the digest that its header states.

Equal payloads are stored once: the record with the smallest id is the ``response``, the others are
``revisit`` records that refer to it and hold its HTTP header only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import discard, settle, shared_dir

LEAST_REVISIT = 100  # bytes of payload from which copies become revisits
FILE_BYTES = 256 << 20  # an archive file ends with the record that reaches this size
READ_BYTES = 8 << 20  # one read fetches at most this much, or one record
GAP_BYTES = 64 << 10  # unwanted bytes between two records that one read may fetch
CHUNK_BYTES = 4 << 20  # span of a file that one task reads in order
TASK_BYTES = 1 << 30  # bytes that a reading task handles, at most about

# ---- fixed values: names of the format ----
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("file string, offset long, length long, page_id long, url string, payload_digest string, "
         "record_type string")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")
PAYLOAD = ", payload binary"

_CONTROL = re.compile("[\x00-\x20\x7f]")


def _folder(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder named by a URI or a plain path."""
    return (arrow_fs.FileSystem.from_uri(root) if re.match("[a-zA-Z][a-zA-Z0-9+.-]+:", root)
            else (arrow_fs.LocalFileSystem(), root))


def _uri(url: str) -> str:
    """A header value: blanks and control characters are escaped."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def member(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes,
           level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields,
            ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"".join([VERSION, b"\r\n", lines, b"\r\n", block, b"\r\n\r\n"])
                         ) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str,
                refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    fields = [] if url is None else [("WARC-Target-URI", _uri(url))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if not revisit:
        return member("response", _page(page_id), date, fields, http + payload)
    fields += [("WARC-Refers-To", _page(refers_to)), ("WARC-Profile", PROFILE)]
    return member("revisit", _page(page_id), date, fields, http)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version.encode() != VERSION:
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} does not end where it should")
    return fields, rest[:n]


def _number(urn: str | None) -> int | None:
    digits = urn[len("<urn:page:"):-1] if urn else ""
    return int(digits) if digits else None


def _writer(root: str, date: str, file_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _folder(root)
        system.create_dir(folder, recursive=True)
        out, name, at, rows = None, "", 0, []

        def closed() -> pd.DataFrame:
            out.close()
            return _frame(rows, ["file", "offset", "length", "page_id", "url", "payload_digest",
                                 "record_type"])

        for pdf in batches:
            for page, url, payload, digest, first, revisit in zip(*[pdf[c] for c in (
                    "page_id", "url", "payload", "digest", "first", "revisit")]):
                page = None if page is None else int(page)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, rows = system.open_output_stream(f"{folder}/{name}", compression=None), []
                    info = member("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, [
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                data = page_record(page, url, payload, digest, date,
                                   int(first) if revisit else None, revisit)
                out.write(data)
                rows.append((name, at, len(data), page, url, digest,
                             "revisit" if revisit else "response"))
                at += len(data)
                if at >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
    return write


def _planned(pages: DataFrame, page_id: str, url: str, html: str, least: int
             ) -> tuple[DataFrame, DataFrame]:
    """Records to write: page_id, url, payload, digest, first (smallest id with the payload) and
    revisit; and the digests that occur twice. Only those are joined back: where they are few, Spark
    broadcasts them by its own threshold, and it splits a digest of very many pages otherwise."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"),
                        F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = settle(rows.where(F.octet_length("payload") >= least).groupBy("digest")
                    .agg(F.count("*").alias("k"), F.min("page_id").alias("first"))
                    .where("k > 1 and first is not null").drop("k"), "warc-copies")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    planned = rows.join(copies, "digest", "left").select(
        F.col("page_id").cast("string"), "url", "payload", "digest", F.col("first").cast("string"),
        revisit.alias("revisit"))
    return planned, copies


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", least: int = LEAST_REVISIT,
                   date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to archive files in ``folder``, a path or URI that all
    executors share, and return the index, a written table: file, offset, length, page_id, url,
    payload_digest, record_type.

    The payload is the text in UTF-8; NULL is empty. Payloads of fewer than ``least`` bytes are never
    revisits. Rows that repeat the smallest id of their payload are all responses; rows without an
    id are revisits where another row has one, and responses otherwise. A NULL url has no target
    URI. Ids are integers. Other columns are not written. An empty table writes no file.
    """
    planned, copies = _planned(pages, page_id, url, html, least)
    index = settle(planned.mapInPandas(_writer(folder, date, file_bytes), INDEX), "warc-index")
    discard(copies)
    return index


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES
              ) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) -> reads as (first range, one past the last, bytes): neighbours share
    a read if at most ``gap`` bytes lie between them and it stays within ``most`` bytes."""
    reads = []
    start = 0
    for i in range(1, len(ranges) + 1):
        end = ranges[i - 1][0] + ranges[i - 1][1]
        if (i == len(ranges) or ranges[i][0] - end > gap
                or ranges[i][0] + ranges[i][1] - ranges[start][0] > most):
            if start < i:
                reads.append((start, i, end - ranges[start][0]))
            start = i
    return reads


def _reader(root: str, payloads: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _folder(root)
        for pdf in batches:  # sorted by file and offset
            for name, rows in pdf.groupby("file", sort=False):
                ranges = list(zip(rows["offset"].tolist(), rows["length"].tolist()))
                urls = rows["url"].tolist()
                with system.open_input_file(f"{folder}/{name}") as archive:
                    for first, last, size in coalesced(ranges):
                        begin = ranges[first][0]
                        data = archive.read_at(size, begin)
                        found = _records([(data[o - begin:o - begin + n], u) for (o, n), u in zip(
                            ranges[first:last], urls[first:last])])
                        yield found if payloads else found.drop(columns="payload")
    return read


def _records(found: list[tuple[bytes, str | None]]) -> pd.DataFrame:
    rows = []
    for data, url in found:
        fields, block = parse(data)
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        kind, page = fields["WARC-Type"], _number(fields["WARC-Record-ID"])
        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size,
                                                                                         digest):
            raise ValueError(f"record of page {page} does not have the payload it states")
        rows.append((page, url, kind, _number(fields.get("WARC-Refers-To")), size, digest,
                     payload if kind == "response" else None))
    return _frame(rows, ["page_id", "url", "record_type", "refers_to", "payload_bytes",
                         "payload_digest", "payload"])


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Ids that may be absent stay integers."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({name: pd.Series(list(c), dtype="Int64" if name in (
        "page_id", "refers_to") else None) for name, c in zip(names, columns)})


def read_archives(index: DataFrame, folder: str, payloads: bool = True, chunk: int = CHUNK_BYTES
                  ) -> DataFrame:
    """The records that the rows of ``index`` name, all or a selection of what ``write_archives``
    returned: page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload
    (left out without ``payloads``; it is read and checked all the same).

    payload_bytes and payload_digest are those of the full payload; payload is NULL for a revisit.
    A record that does not match its header raises. Only the index is shuffled: a task gets the rows
    of some chunks of ``chunk`` bytes of a file in the order of their offsets. The index is small
    against what it names, so the number of tasks follows the bytes to read.
    """
    size = index.agg(F.sum("length")).first()[0] or 0
    usual = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(usual, -(-size // chunk)), -(-size // TASK_BYTES))
    return (index.select("file", "offset", "length", "url")
            .withColumn("chunk", F.floor(F.col("offset") / chunk))
            .repartition(tasks, "file", "chunk").sortWithinPartitions("file", "offset")
            .drop("chunk").mapInPandas(_reader(folder, payloads),
                                       RECORD if payloads else RECORD.removesuffix(PAYLOAD)))


def archive_folder(spark) -> str:
    """A new folder for archives in the cluster's shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
