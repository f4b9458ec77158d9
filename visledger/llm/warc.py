"""WARC archives through a chunked record table.

A payload is a run of rows (record, chunk number, bytes), each with the SHA-1 of
the payload so far, so no task holds a whole oversized record. Archives are
written and read chunk by chunk as well, one gzip member for each record.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, new_path, open_shared, rename_shared, skewed_join, small_batches

CHUNK = 256 << 10
#: Equal payloads of at least so many bytes are written once and revisited.
REVISIT_BYTES = 1000
_DATE = "2020-01-01T00:00:00Z"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Rows ``record, page, url, chunk_no, last, n_bytes, sha1, data`` of every payload, in order.

    ``sha1`` covers the payload up to and including the row's chunk; ``n_bytes``
    is the whole payload's length. A null or empty payload is one empty chunk.
    Null ids and URLs stay null; repeated rows are records of their own; further
    columns are not read; an empty table gives an empty one.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("body"),
    )
    n_chunks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(chunk))).cast("int")
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long"))
    parts = rows.select(
        "record", "page", "url", "n_bytes", n_chunks.alias("n"), "body", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk_no")
    ).select(
        "record", "page", "url", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), "n_bytes",
        F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"),
    )

    def digest(batches):
        running = hashlib.sha1()
        for b in batches:
            out = []
            for no, data in zip(b.column(3).to_pylist(), b.column(6)):
                if no == 0:
                    running = hashlib.sha1()
                running.update(data.as_buffer())
                out.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "sha1"])

    return small_batches(parts).mapInArrow(
        digest, "record long, page long, url string, chunk_no int, last boolean, n_bytes long, data binary, sha1 string"
    )


def plan_revisits(chunks: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows ``record, to_record, to_page`` for each record that revisits another of equal payload.

    Of equal payloads of at least ``least_bytes``, the record with the largest
    page id (null least; of equal ones the last record) is written out. The
    records of a payload that very many share are dealt to many parts.
    """
    keys = ["n_bytes", "sha1"]
    whole = chunks.where(F.col("last") & (F.col("n_bytes") >= least_bytes)).select("record", "page", *keys)
    first = whole.groupBy(*keys).agg(F.max(F.struct("page", "record")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "warc-repeated")
    joined = skewed_join(whole, first.drop("n"), keys, hot_keys(first, keys), "record").where(F.col("record") != F.col("kept.record"))
    return joined.select("record", F.col("kept.record").alias("to_record"), F.col("kept.page").alias("to_page"))


def _urn(record: int) -> str:
    return f"<urn:uuid:00000000-0000-4000-{record >> 48 & 0xFFFF:04x}-{record & (1 << 48) - 1:012x}>"


def _clean(text: str | None) -> str:
    return " ".join((text or "").split())


def _head(row: dict) -> bytes:
    """WARC and HTTP header lines of a record."""
    page = "" if row["page"] is None else str(row["page"])
    http = b"" if row["revisit"] else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {_urn(row['record'])}",
        f"WARC-Target-URI: {_clean(row['url'])}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{row['sha1']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if row['revisit'] else row['n_bytes'])}",
        f"X-Page-ID: {page}", f"X-Payload-Length: {row['n_bytes']}",
    ]
    if row["revisit"]:
        to = "" if row["to_page"] is None else str(row["to_page"])
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(row['to_record'])}", f"X-Refers-To-Page-ID: {to}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK, **columns) -> DataFrame:
    """Write one WARC record for each row of ``pages``; returns the manifest ``path, n_records``.

    Each task writes one ``.warc.gz`` under a name of its attempt and renames it
    when whole, so a lost executor leaves no half archive. Null and empty
    payloads are responses without a body; null ids and URLs have empty headers;
    URLs are written with their white space reduced, as a header is one line.
    Repeated rows are records of their own; an empty table gives no archive.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    chunks = materialize(chunk_table(pages, chunk=chunk, **columns), "warc-chunks")
    revisits = materialize(plan_revisits(chunks), "warc-revisits")
    whole = chunks.where("last").select("record", F.col("sha1").alias("payload_sha1"))
    heads = whole.join(revisits, "record", "left").select(
        F.col("record").alias("hr"), "payload_sha1", "to_record", "to_page", F.col("to_record").isNotNull().alias("revisit")
    )
    rows = chunks.drop("sha1").join(heads, F.col("record") == F.col("hr")).where("not revisit or chunk_no = 0")
    rows = rows.select(
        "record", "page", "url", "chunk_no", "last", "n_bytes", F.col("payload_sha1").alias("sha1"), "revisit", "to_record", "to_page",
        F.when(~F.col("revisit"), F.col("data")).alias("data"),
    ).sortWithinPartitions("record", "chunk_no")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        final, tried = f"{folder}/{name}.warc.gz", f"{folder}/_tried-{name}-{task.taskAttemptId()}"
        out, packer, n = None, None, 0
        for b in batches:
            heads = b.drop_columns(["data"]).to_pylist()
            for row, data in zip(heads, b.column("data")):
                out = out or open_shared(tried, "wb")
                if row["chunk_no"] == 0:
                    packer, n = zlib.compressobj(4, zlib.DEFLATED, 31), n + 1
                    out.write(packer.compress(_head(row)))
                if data.is_valid:
                    out.write(packer.compress(data.as_buffer()))
                if row["last"] or row["revisit"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out:
            out.close()
            rename_shared(tried, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "n_records": [n]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return materialize(small_batches(rows).mapInArrow(run, "path string, n_records long"), "warc-manifest")


class _Members:
    """The bytes of a file of gzip members, in portions."""

    def __init__(self, stream, portion: int = CHUNK):
        self.stream, self.portion, self.packed, self.plain, self.open = stream, portion, b"", bytearray(), None

    def more(self) -> bool:
        if not self.packed:
            self.packed = self.stream.read(self.portion)
            if not self.packed:
                held = self.open.decompress(b"", self.portion) if self.open else b""
                self.plain += held
                return bool(held)
        self.open = self.open or zlib.decompressobj(31)
        self.plain += self.open.decompress(self.packed, self.portion)
        self.packed = self.open.unconsumed_tail or self.open.unused_data
        if self.open.eof:
            self.open = None
        return True

    def until(self, end: bytes) -> bytes:
        at = self.plain.find(end)
        while at < 0:
            if not self.more():
                return b""
            at = self.plain.find(end)
        out = bytes(self.plain[: at + len(end)])
        del self.plain[: at + len(end)]
        return out

    def exactly(self, n: int):
        while n:
            if not self.plain and not self.more():
                raise ValueError("archive ends within a record")
            part = bytes(self.plain[:n])
            del self.plain[: len(part)]
            n -= len(part)
            if part:
                yield part


def read_records(stream):
    """Headers, and for a response the length and SHA-1 of the payload as read, of every record of an archive."""
    source = _Members(stream)
    while head := source.until(b"\r\n\r\n"):
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")[1:]
        fields = {k: v for k, v in (x.partition(": ")[::2] for x in lines)}
        left, size, sha = int(fields["Content-Length"]), 0, hashlib.sha1()
        if fields["WARC-Type"] == "response":
            left -= len(source.until(b"\r\n\r\n"))
        for part in source.exactly(left):
            size += len(part)
            sha.update(part)
        for _ in source.exactly(4):
            pass
        yield fields, size, sha.hexdigest()


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per record of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's length and digest are those of the payload that was read; a
    revisit's are those in its header.
    """
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with open_shared(path, "rb") as stream:
                    for f, size, sha in read_records(stream):
                        page = int(f["X-Page-ID"]) if f["X-Page-ID"] else None
                        if f["WARC-Type"] == "response":
                            rows.append((page, size, sha, "response", None))
                        else:
                            to = f["X-Refers-To-Page-ID"]
                            digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                            rows.append((page, int(f["X-Payload-Length"]), digest, "revisit", int(to) if to else None))
                        if len(rows) >= 10_000:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
