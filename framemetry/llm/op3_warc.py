"""WARC archives with an index written first, read back by coalesced byte ranges.

``write_archive`` stores one record per page, each a gzip member of its own, and one index row per record
(file, offset, length, url, digest). ``read_archive`` takes any selection of index rows, sorts them by
file and offset, joins neighbours into byte-range reads of bounded size, deals these out by their bytes, and
parses the records.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page_id is a
response and the others are revisits of it without a payload. Smaller payloads are always responses.

Cases: a null html is an empty payload. A null url or id leaves its header out and reads back as null; a
null id is smaller than any other, and where all ids of a group are null, or rows repeat the largest id,
each of these is a response. Control characters in a url are percent-encoded in the archive. An empty
table gives an empty archive and index.

Lost executors: a task writes files under names of its own attempt, and the index names only files of
the attempts that committed it; files of lost attempts are never read. Paths go through pyarrow's file
systems, so the folder may be any shared store they know.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framemetry.llm.common import table
from framemetry.llm.registry import query
from framemetry.session import shared_dir, written

MIN_REVISIT = 1000  # bytes of payload
FILE_BYTES = 256 << 20  # a file is closed beyond this
RUN_BYTES = 8 << 20  # start offsets of a run lie in one stretch of this size
TASK_BYTES = 64 << 20  # of archive that a task reads, and at most one run more
GAP_BYTES = 64 << 10  # unselected bytes that are read over rather than skipped
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time

INDEX = (
    "file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, "
    "record_type string"
)
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload string"
)
_CONTROL = re.compile("[\x00-\x1f\x7f]")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    payload = (html or "").encode()
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: {_record_id(page_id, digest)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append("Content-Type: text/html; charset=utf-8")
    if url is not None:
        uri = _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url)
        head.append(f"WARC-Target-URI: {uri}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
        head.append(f"X-Payload-Length: {len(payload)}")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode(record: bytes) -> tuple:
    """A row of RECORD; raises if the record is broken."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    payload = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError(f"not a record: {head[:80]!r}")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, page, url = fields["WARC-Type"], fields.get("X-Page-Id"), fields.get("WARC-Target-URI")
    page_id = None if page is None else int(page)
    if kind == "revisit":
        return page_id, url, kind, int(fields["X-Refers-To-Page-Id"]), int(fields["X-Payload-Length"]), digest, None
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {page} does not match its digest")
    return page_id, url, kind, None, len(payload), digest, payload.decode()


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): which record each page revisits, null for responses.

    The groups are reduced map-side to (digest, largest id, rows); the join back is an equi-join whose
    hot digests adaptive execution splits."""
    keyed = pages.select(
        "page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_d"),
        (F.coalesce(F.octet_length("html"), F.lit(0)) >= MIN_REVISIT).alias("_long"),
    )
    first = (
        keyed.where("_long").groupBy("_d").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").select(F.col("_d").alias("_k"), "_first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return keyed.join(first, keyed["_d"] == first["_k"], "left").select(
        "page_id", "url", "html", F.when(F.col("_long") & other, F.col("_first")).alias("refers_to")
    )


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the committed index."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        files.create_dir(f"{root}/data", recursive=True)
                        out = files.open_output_stream(f"{root}/data/{name}", compression=None)
                    body = encode(page["page_id"], page["url"], page["html"], page["refers_to"])
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(body) + pack.flush()
                    out.write(member)
                    digest = hashlib.sha1((page["html"] or "").encode()).hexdigest()
                    kind = "response" if page["refers_to"] is None else "revisit"
                    rows.append((name, at, len(member), page["page_id"], page["url"], digest, kind))
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                names = [c.split()[0] for c in INDEX.split(", ")]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    marked(pages).mapInArrow(store, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def byte_ranges(index: DataFrame) -> DataFrame:
    """(file, start, stop, parts): neighbours of the selection joined into one read each.

    A file's records are bounded by FILE_BYTES, a run's by RUN_BYTES."""
    w = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.struct("offset", (F.col("offset") + F.col("length")).alias("stop"))).over(w)
    fresh = (
        before.isNull()
        | (F.col("offset") - before["stop"] > GAP_BYTES)
        | (F.floor(F.col("offset") / RUN_BYTES) != F.floor(before["offset"] / RUN_BYTES))
    )
    runs = index.select("file", "offset", "length", F.when(fresh, 1).otherwise(0).alias("fresh"))
    runs = runs.withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("file", "run").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"),
    )


def dealt(runs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Runs (file, start, stop, ...) dealt out by the bytes they make a task read, not by their own size: each
    partition is the runs of one stretch of ``task_bytes`` in the order of files. Files are numbered in one
    window, a row for each FILE_BYTES of archive."""
    runs = written(runs.withColumn("_bytes", F.col("stop") - F.col("start")), "runs")
    files = runs.groupBy("file").agg(F.sum("_bytes").alias("_whole"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_whole").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_at", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).join(files, "file")
    total = runs.agg(F.sum("_bytes")).first()[0] or 0
    stretch = F.floor((F.col("_base") + F.col("_at")) / task_bytes).cast("int")
    return placed.repartitionById(total // task_bytes + 1, stretch).drop("_bytes", "_base", "_at")


def read_archive(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` rows name. Without ``payloads``, they are checked and left out."""
    columns = RECORD if payloads else RECORD.rpartition(", ")[0]
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.slice(i, 1).to_pylist()[0]
                with files.open_input_file(f"{root}/data/{run['file']}") as source:
                    block = source.read_at(run["stop"] - run["start"], run["start"])
                rows = []
                for part in run["parts"]:
                    at = part["offset"] - run["start"]
                    record = zlib.decompress(block[at : at + part["length"]], 31)
                    rows.append(decode(record)[: len(names)])
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return dealt(byte_ranges(index)).select("file", "start", "stop", "parts").mapInArrow(load, columns)


def archived(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write, index and read back all of ``pages``."""
    folder = shared_dir(spark, "warc")
    return read_archive(write_archive(pages, folder), folder, payloads)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
             CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first
      FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM g"""


@query("op3_warc", SQL)
def op3_warc(spark, sf):
    return archived(spark, table(spark, sf, "pages"), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
