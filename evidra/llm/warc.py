"""WARC archives with an index (operator 3): write, then read chosen records by coalesced byte ranges.

Every record is a gzip member of its own, so a record can be read from its offset alone. Each task writes
archives of its own and returns an index row per record: path, offset, length, URL, digest. The index is
a table; readers sort the rows they want by place and join neighbouring ones to one read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evidra.llm.common import batch, lookup_bounded, work_dir, written
from evidra.llm.files import create, new_name, open_random

LEAST_REVISIT = 100
ARCHIVE_BYTES = 1 << 30
#: Wanted records at most ``GAP`` bytes apart are read together, up to about ``READ`` bytes.
GAP, READ = 64 << 10, 8 << 20
STRETCH = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, path string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "page records").int >> 64
_MASK = (1 << 64) - 1


def record_id(page_id: int | None) -> str:
    """A page's record id; the page's id can be read off it. A page without id has the nil id."""
    number = 0 if page_id is None else (_SPACE << 64) | (page_id & _MASK)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(identifier: str) -> int | None:
    number = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    low = number & _MASK
    return None if number == 0 else low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, its HTTP header and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """The index of archives of all pages, a written table.

    Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes, those with the smallest page_id are
    responses and the others revisits of it, without payload. Pages without id come last.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    key = F.when(F.octet_length("html") >= LEAST_REVISIT, F.col("digest")).alias("_key")
    firsts = pages.select(key, "page_id").where("_key is not null").groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    told = lookup_bounded(pages.withColumn("_key", key), firsts.where("copies > 1"), "_key", F.col("copies"))
    told = told.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))

    def write(batches):
        out, path, offset = None, None, 0
        try:
            for rows in batches:
                made: list[list] = [[], [], []]
                columns = [rows.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit")]
                for page_id, url, html, digest, first, revisit in zip(*columns):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path, offset = new_name(folder, ".warc.gz"), 0
                        out = create(path)
                    data = gzip.compress(record(page_id, url, html.encode(), digest, first, revisit), 3, mtime=0)
                    out.write(data)
                    for to, value in zip(made, (path, offset, len(data))):
                        to.append(value)
                    offset += len(data)
                kind = ["revisit" if r else "response" for r in columns[5]]
                refers = [f if r else None for f, r in zip(columns[4], columns[5])]
                yield batch(INDEX, columns[0], *made, columns[1], columns[3], kind, refers)
        finally:
            if out is not None:
                out.close()

    return written(told.select("page_id", "url", "html", "digest", "first", "revisit").mapInArrow(write, INDEX))


def ranges(offset: np.ndarray, length: np.ndarray, path: list[str]) -> list[tuple[int, int]]:
    """Runs [a, b) of rows, sorted by place, that one read serves."""
    out, a = [], 0
    for i in range(1, len(offset) + 1):
        if i == len(offset) or path[i] != path[a] or offset[i] - offset[i - 1] - length[i - 1] > GAP or offset[i] + length[i] - offset[a] > READ:
            out.append((a, i))
            a = i
    return out if len(offset) else []


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the indexed records, from the archives.

    A response's length and digest are those of the payload read, checked against its header; a revisit's
    are those its headers give for the full payload.
    """

    def read(batches):
        source, opened = None, None
        for rows in batches:
            path = rows.column("path").to_pylist()
            offset, length = rows.column("offset").to_numpy(), rows.column("length").to_numpy()
            made: list[tuple] = []
            for a, b in ranges(offset, length, path):
                if path[a] != opened:
                    source, opened = open_random(path[a]), path[a]
                data = source.read_at(int(offset[b - 1] + length[b - 1] - offset[a]), int(offset[a]))
                for at, n in zip((offset[a:b] - offset[a]).tolist(), length[a:b].tolist()):
                    fields, http, payload = parsed(zlib.decompress(data[at : at + n], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, refers = len(payload), None
                    if fields["WARC-Type"] == "revisit":
                        refers = page_of(fields["WARC-Refers-To"])
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload does not match its digest")
                    made.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers))
            yield batch(RECORD, *(list(c) for c in (zip(*made) if made else [()] * 5)))

    stretch = (F.col("offset") / STRETCH).cast("long").alias("_stretch")
    wanted = index.select("path", "offset", "length", stretch).repartition("path", "_stretch")
    return wanted.sortWithinPartitions("path", "offset").mapInArrow(read, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives and read every record back.

    A null html is an empty payload, a null url has no target field, pages without id keep none; repeated
    rows are records of their own (all responses where their page_id is the smallest). An empty table
    gives no rows; only page_id, url and html are read.
    """
    return read_records(write_archives(pages, work_dir(pages.sparkSession, "warc")))
