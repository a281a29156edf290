"""WARC archives as a chunked record table: oversized payloads travel as (record, chunk number) rows.

``payload_chunks`` cuts every payload into rows (row, chunk number, at most ``CHUNK`` bytes) in Spark, and saves them.
Digests are carried from chunk to chunk: a payload of one chunk is digested where it is, chunks of larger ones are dealt by
row and sorted by number. ``write`` turns every chunk row by itself into a WARC/1.1 record, a gzip member of its own: a
payload of several chunks is a ``response`` record with WARC-Segment-Number 1 and ``continuation`` records, each with an id of
its own, the origin's id and, in the last one, the total length (segmentation as the standard has it). So chunks of one
payload may be written by different tasks, and Python holds a few chunks, never a payload. Rows on their way back are blocks
of whole members of about ``BLOCK`` bytes, and an archive takes ``archive_blocks`` of them.

``chunks`` reads archives back into the chunk table: rows (record, chunk number, payload bytes so far, running SHA-256, last
or not). A record of one chunk is digested while its archive streams by; chunks of oversized ones are dealt by record,
sorted by chunk number, and the digest is carried from row to row: no task holds more than a chunk and a bounded archive.
``records`` keeps the last chunk row of each record.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page_id is a ``response`` (of
repeated rows of that page one), the others are ``revisit`` records without payload that refer to it. Record ids are unique:
a response that others may refer to is named by page and digest, any other record by its row.

Defined results: a null html is an empty payload; a null or empty url, or one of more than ``MOST_URL`` bytes, is written as
an empty target, line ends in it as blanks; a null page_id is always a response, is never referred to and comes back as
null; further rows that repeat the smallest page_id of a payload revisit it; an empty table gives an empty result; only
page_id, url and html are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

CHUNK = 1 << 18
MIN_REVISIT = 100
MOST_URL = 1 << 16
#: Bytes of a block of members, about, and blocks of an archive: 16 MB hold an archive in memory.
BLOCK, ARCHIVE_BLOCKS = 1 << 20, 16
#: Up to this many revisits and payloads of several chunks (about 100 bytes each) are broadcast, and no chunk is shuffled.
BROADCAST_REVISITS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16


def payload_chunks(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``row``, ``page_id``, ``url``, ``n`` (bytes of the payload), ``k`` (from 1), ``data``: the payloads in chunks. Saved."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    url = F.translate(F.coalesce(F.col("url"), F.lit("")), "\r\n", "  ")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.when(F.octet_length(url) <= MOST_URL, url).otherwise("").alias("url"), raw.alias("raw"))
    rows = rows.withColumn("n", F.octet_length("raw").cast("long"))
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int")
    each = rows.select("row", "page_id", "url", "n", "raw", F.explode(F.sequence(F.lit(1), last)).alias("k"))
    return common.saved(each.select("row", "page_id", "url", "n", "k", F.substring("raw", (F.col("k") - 1) * chunk + 1, F.lit(chunk)).alias("data")), "payloads")


def digests(table: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``row``, ``page_id``, ``n``, ``digest`` of every payload of a chunk table."""
    one = table.where(F.col("n") <= chunk).select("row", "page_id", "n", F.sha2("data", 256).alias("digest"))
    parts = table.where(F.col("n") > chunk).select("row", "page_id", "n", "k", "data").repartition("row").sortWithinPartitions("row", "k")

    def run(batches):
        row, sha, done = None, hashlib.sha256(), 0
        for batch in batches:
            out = []
            for i, (own, page, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if own != row:
                    row, sha, done = own, hashlib.sha256(), 0
                data = batch.column(4)[i].as_buffer()
                sha.update(data)
                done += data.size
                if done == n:
                    out.append((own, page, n, sha.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["row", "page_id", "n", "digest"])

    return one.unionByName(parts.mapInArrow(run, "row long, page_id long, n long, digest string"))


def roles(found: DataFrame) -> DataFrame:
    """``row``, ``refers_to`` of the payloads (row, page_id, n, digest) that revisit another one."""
    narrow = found.where((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    order = F.struct("page_id", "row")
    first = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("q_rows")).where("q_rows > 1").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("q_first"))
    # a digest with very many pages is split by adaptive execution: both sides are plain and narrow
    return narrow.join(first, "digest").where("row <> q_first").select("row", "refers_to")


def _member(head: list[tuple[str, object]], body: bytes | memoryview, more: bytes | memoryview = b"") -> bytes:
    """A WARC record as a gzip member."""
    fields = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(body) + len(more))])
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([gz.compress(f"WARC/1.1\r\n{fields}\r\n".encode("utf-8", "surrogatepass")), gz.compress(body), gz.compress(more), gz.compress(b"\r\n\r\n"), gz.flush()])


def member(page_id: int | None, url: str, data: memoryview, k: int, n: int, sha: str, refers_to: int | None, row: int, date: str, chunk: int = CHUNK) -> bytes | None:
    """The gzip member of chunk ``k`` of a payload of ``n`` bytes and digest ``sha``; none for further chunks of a revisit."""
    # a page's name follows from its id and payload, so that revisits can tell it; others have the row's
    named = page_id is not None and refers_to is None and n >= MIN_REVISIT
    name = f"<urn:page:{page_id}:{sha}>" if named else f"<urn:row:{row}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", url), ("WARC-Date", date)]
    own = [("WARC-Payload-Digest", f"sha256:{sha}"), ("X-Payload-Length", n), ("X-Page-Id", "" if page_id is None else page_id), ("X-Row", row)]
    kind = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), *shared, ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        again = [("WARC-Refers-To", f"<urn:page:{refers_to}:{sha}>"), ("WARC-Profile", PROFILE)]
        return _member([*kind, *again, *own], http) if k == 1 else None
    if n <= chunk:
        return _member([*kind, *own], http, data)
    if k == 1:
        return _member([*kind, *own, ("WARC-Segment-Number", 1)], http, data)
    head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:segment:{row}:{k}>"), *shared, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *own]
    return _member(head + ([("WARC-Segment-Total-Length", len(http) + n)] if k == -(-n // chunk) else []), data)


def write(pages: DataFrame, path: str, date: str | None = None, chunk: int = CHUNK, block: int = BLOCK, archive_blocks: int | None = None) -> None:
    """Write archives below ``path``. ``date``: WARC-Date of the records, by default now; ``archive_blocks``: blocks of an archive."""
    spark = pages.sparkSession
    common.prepare(spark)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    table = payload_chunks(pages, chunk)
    found = common.saved(digests(table, chunk), "digests")
    # what a chunk cannot tell of its payload: of which page it is a copy, and the digest of several chunks
    told = found.where(F.col("n") > chunk).select("row", "digest").join(roles(found), "row", "full_outer")
    told = common.saved(told, "revisits")
    if told.count() <= BROADCAST_REVISITS:
        told = F.broadcast(told)
    joined = table.join(told, "row", "left").select("page_id", "url", "data", "k", "n", "digest", "refers_to", "row")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() if c != 2 else batch.column(c) for c in range(8)]
            for page_id, url, data, k, n, digest, refers_to, row in zip(*columns, strict=True):
                payload = memoryview(data.as_buffer() or b"")
                made = member(page_id, url, payload, k, n, digest or hashlib.sha256(payload).hexdigest(), refers_to, row, date, chunk)
                if made is None:
                    continue
                held.append(made)
                size += len(made)
                if size >= block:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    # a member ends with its size, whose last byte is 0 as it holds a chunk: as the line end of Spark's text writer it comes
    # after every block, so what is written are whole members and nothing else
    blocks = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.option("lineSep", "\0").option("maxRecordsPerFile", archive_blocks or ARCHIVE_BLOCKS).text(path)


class _Stream:
    """Reads a gzip archive piece by piece; holds no more than what is asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.gz, self.buffer = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while True:
            if self.gz.eof:  # what is left belongs to the next member, whatever else the object says of it
                piece, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            else:
                piece = self.gz.unconsumed_tail
            if not piece:
                piece = self.data[self.at : self.at + _READ]
                self.at += len(piece)
            got = self.gz.decompress(piece, _READ)
            if got:
                self.buffer += got
                return True
            if not piece:
                return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (end := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise ValueError("archive ends within a record")
            part = bytes(self.buffer[:size])
            del self.buffer[: len(part)]
            size -= len(part)
            yield part


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive, one segment at a time: its fields, its payload's size and digest, and of segments the payload."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        field = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
        size, segment = int(field["Content-Length"]), int(field.get("WARC-Segment-Number", 0))
        digest, done, kept = hashlib.sha256(), 0, []
        if segment <= 1:
            http = stream.until(b"\r\n\r\n")
            if http is None:
                raise ValueError("archive ends within a record")
            size -= len(http) + 4
        for part in stream.body(size):
            digest.update(part)
            done += len(part)
            if segment:
                kept.append(part)
        if stream.until(b"\r\n\r\n") is None:
            raise ValueError("a record is not closed")
        refers = field.get("WARC-Refers-To")
        yield {
            "record": field["X-Row"], "page_id": int(field["X-Page-Id"]) if field.get("X-Page-Id") else None, "chunk": max(1, segment), "bytes": done, "digest": digest.hexdigest(),
            "last": not segment or "WARC-Segment-Total-Length" in field, "record_type": "revisit" if field["WARC-Type"] == "revisit" else "response", "refers_to": int(refers.split(":")[2]) if refers else None,
            "declared_digest": field["WARC-Payload-Digest"].removeprefix("sha256:"), "declared_bytes": int(field["X-Payload-Length"]), "data": b"".join(kept) if segment else None,
        }


CHUNK_SCHEMA = "record string, page_id long, chunk int, bytes long, digest string, last boolean, record_type string, refers_to long, declared_digest string, declared_bytes long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def chunks(spark, path: str) -> DataFrame:
    """The chunk table of all archives below ``path``: of each record's chunks, payload bytes and SHA-256 up to each one's end."""
    common.prepare(spark)
    with_data = f"{CHUNK_SCHEMA}, data binary"
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in with_data.split(", "))])

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for row in parse(data.as_buffer()):
                    rows.append(row)
                    size += len(row["data"] or b"") + 500
                    if size >= common.BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def carried(batches):
        record, digest, done = None, hashlib.sha256(), 0
        for batch in batches:
            names, at = batch.column(0).to_pylist(), batch.schema.names.index("data")
            total, sha = [], []
            for i, name in enumerate(names):
                if name != record:
                    record, digest, done = name, hashlib.sha256(), 0
                part = batch.column(at)[i].as_buffer()
                digest.update(part)
                done += part.size
                total.append(done)
                sha.append(digest.hexdigest())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"bytes": pa.array(total, pa.int64()), "digest": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names[:-1]], schema.names[:-1])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, with_data)
    found = common.saved(found, "chunks")
    dealt = found.where("data is not null").repartition("record").sortWithinPartitions("record", "chunk")
    return found.where("data is null").drop("data").unionByName(dealt.mapInArrow(carried, CHUNK_SCHEMA))


def records(spark, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``intact`` of every record."""
    done = chunks(spark, path).where("last")
    own = F.col("record_type") == "response"
    return done.select(
        "page_id",
        F.when(own, F.col("bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (~own | ((F.col("digest") == F.col("declared_digest")) & (F.col("bytes") == F.col("declared_bytes")))).alias("intact"),
    )


def oracle() -> str:
    return """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
    SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
           CASE WHEN n >= 100 AND p.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND p.page_id > first_id THEN first_id END AS refers_to, TRUE AS intact
    FROM p JOIN f USING (d)
    """
