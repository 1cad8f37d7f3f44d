"""WARC archives: written with an index first, then read by coalesced byte ranges.

Each task writes its records to an archive of its own, under a name that no other attempt uses, and
returns an index row per record: archive, offset, length, URL and digest. The index is stored; a task
that is run again leaves a file that no index row names. Reading takes index rows of any selection,
sorts them by archive and offset, joins ranges that are close to each other into one read, and parses
the records from it.

Archives lie in the folder that the cluster shares, which is opened through pyarrow's file systems
(``file:``, ``hdfs:``, ``s3:`` and others), on the executors only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, new_path, small_batches, small_enough, tidy

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10
_DATE = "2000-01-01T00:00:00Z"  # fixed, so that archives depend on their pages alone


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record: an HTTP response, or a revisit that has its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    uri = _clean(url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, uri, digest, kind)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and the payload of one record; raises on a malformed one."""

    def headers(raw: bytes, first: str) -> dict[str, str]:
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith(first):
            raise ValueError(f"not a {first} head: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    raw, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(raw, "WARC/")
    n = int(warc["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its head")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return warc, headers(http, "HTTP/"), payload


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id long, url, html) with digest, kind and refers_to.

    Of rows with one payload of least_bytes or more, those with the smallest page_id are responses
    and the rest revisit it (rows that repeat that id are responses too; if all ids are null, all
    are). Smaller payloads and null ones (empty) are responses. The texts are not exchanged unless
    there are too many repeated payloads to broadcast.
    """
    rows = pages.withColumns({"html": F.coalesce("html", F.lit("")), "digest": F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)})
    long = rows.where(F.octet_length("html") >= least_bytes)
    again = materialize(long.groupBy("digest").agg(F.min("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 AND top IS NOT NULL").select("digest", "top"), "payloads")
    rows = rows.join(F.broadcast(again) if small_enough(again) else again, "digest", "left")
    repeat = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.withColumns({"kind": F.when(repeat, "revisit").otherwise("response"), "refers_to": F.when(repeat, F.col("top"))}).drop("top")


_INDEX = "archive string, offset long, length long, page_id long, url string, digest string"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_revisits() and returns the stored index: archive, offset, length, page_id, url, digest."""
    spark = records.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, where, path = None, "", 0, None, ""
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        where, path = _filesystem(folder)
                        where.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc", 0
                        out = where.open_output_stream(f"{path}/{name}")
                    data = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["kind"], r["refers_to"])
                    out.write(data)
                    rows.append({"archive": f"{folder}/{name}", "offset": at, "length": len(data), "page_id": r["page_id"], "url": r["url"], "digest": r["digest"]})
                    at += len(data)
                schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        finally:
            if out is not None:
                out.close()

    wanted = records.select("page_id", "url", "html", "digest", "kind", "refers_to")
    return materialize(wanted.mapInArrow(tidy(write), _INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, numbers of the ranges in it) for sorted (offset, length); a read is over most bytes only if one range is."""
    out: list[list] = []
    for i, (a, n) in enumerate(ranges):
        if out and a - out[-1][1] <= gap and max(out[-1][1], a + n) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], a + n)
            out[-1][2].append(i)
        else:
            out.append([a, a + n, [i]])
    return [(a, b, k) for a, b, k in out]


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(index: DataFrame, *, payloads: bool = True, most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Rows of one stretch of an archive go to one task, sorted. A response's digest is computed from the
    bytes read and held against its head's; a record that differs from its head or index row raises.
    A revisit has no payload; its size and digest are those that its heads give for the full one.
    """
    small_batches(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        opened, source = None, None
        for b in batches:
            rows = b.to_pylist()
            for name in dict.fromkeys(r["archive"] for r in rows):
                own = [r for r in rows if r["archive"] == name]
                if name != opened:
                    if source is not None:
                        source.close()
                    where, path = _filesystem(name)
                    opened, source = name, where.open_input_file(path)
                for a, z, members in coalesced([(r["offset"], r["length"]) for r in own], most, gap):
                    source.seek(a)
                    data = source.read(z - a)
                    out = []
                    for r in (own[i] for i in members):
                        warc, http, payload = parse(data[r["offset"] - a : r["offset"] - a + r["length"]])
                        kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])) or digest != r["digest"]:
                            raise ValueError(f"a damaged record: {name} at {r['offset']}")
                        page = warc["warc-page-id"]
                        refers = warc.get("warc-refers-to-page-id")
                        out.append({"page_id": int(page) if page else None, "url": r["url"], "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "payload": payload if payloads and kind == "response" else None})
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        if source is not None:
            source.close()

    stretch = F.shiftright("offset", 25)
    dealt = index.withColumn("__vg_s", stretch).repartition("archive", "__vg_s").sortWithinPartitions("archive", "offset").drop("__vg_s")
    return dealt.mapInArrow(tidy(read), _READ)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Archives every row of pages and returns the stored index. Null urls stay null; repeated rows are records of their own."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return write_archives(with_revisits(rows), folder)
