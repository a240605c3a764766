"""WARC archives as a chunked record table.

A record is a run of rows (record_id, chunk_no, last, data, sha1_so_far): the bytes of its chunks in order
are the WARC record, and every chunk carries the digest of the payload up to its end, so that a reader can
stop or check anywhere. Payloads above a chunk are never put together: the writer cuts them with a view on
the input, the reader hashes chunk after chunk. Concatenating the data of all rows of an archive in order of
record and chunk gives a WARC/1.1 file.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is a response and the
others revisit it; shorter payloads are always responses.

Every row has a record of its own. Rows that repeat an id with other payloads differ in the digest, rows that
repeat an id and its payload are one response and its revisits (below `least`: all responses).

Edge cases: null and empty payloads are zero bytes and equal to each other; a null id is written as `-` and read
as null, and is the response of its payload only where no row with an id has it; an empty table gives no records;
other columns are not read, whatever their names; a payload is a view on the input's own buffer.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.reuse import scratch_folder
from barloom.llm.common import join_unique, saved, table
from barloom.llm.registry import query

CHUNK = 1 << 18
BATCH_BYTES = 1 << 23

CHUNKS = "record_id string, chunk_no int, last boolean, data binary, sha1_so_far binary"
PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.NAMESPACE_URL


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page_id: int | None, digest: bytes, copy: int = 0) -> str:
    """The same id for the same page and payload in every run; further rows of both are numbered."""
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest.hex()}:{copy}')}"


def _payload(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _sha1(column: Column) -> Column:
    return F.unhex(F.sha1(_payload(column).cast("binary")))


def plan_records(pages: DataFrame, least: int = 0, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(page_id, digest, payload_bytes, same, is_copy, refers_to) for each page id and digest; `same` rows have
    both. Equal ones are combined before they are shuffled, and hot digests are matched by broadcast."""
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), _sha1(F.col(payload)).alias("digest"),
                          F.octet_length(_payload(F.col(payload))).cast("long").alias("payload_bytes"))
    known = saved(narrow.groupBy("page_id", "digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("same")),
                  "page-digests")
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_rows"))
    joined = join_unique(known, firsts, "digest", "_rows", known.count())
    is_copy = (F.col("payload_bytes") >= least) & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "digest", "payload_bytes", "same", is_copy.alias("is_copy"),
                         F.when(is_copy, F.col("first")).alias("refers_to"))


def _head(page: int | None, url: str | None, digest: bytes, size: int, is_copy: bool, refers_to: int | None, date: str,
          copy: int) -> bytes:
    """WARC and HTTP headers of a record, up to its payload."""
    web = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_copy else 'response'}",
        f"WARC-Record-ID: <{record_name(page, digest, copy)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}", f"WARC-Page-ID: {'-' if page is None else page}",
    ]
    if is_copy:
        lines += [f"WARC-Refers-To: <{record_name(refers_to, digest)}>",
                  f"WARC-Refers-To-Page-ID: {'-' if refers_to is None else refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = len(web) + (0 if is_copy else size)
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode() + web


def record_chunks(page: int | None, url: str | None, payload: bytes | memoryview, digest: bytes, size: int, refers_to: int | None,
                  date: str, chunk: int = CHUNK, is_copy: bool | None = None, copy: int = 0) -> Iterator[tuple]:
    """Rows of one record: the headers and what of the payload fits, then further pieces of the payload;
    the closing line ends go with the last."""
    is_copy = refers_to is not None if is_copy is None else is_copy
    view, so_far, n = memoryview(payload), hashlib.sha1(), 0
    head, at = _head(page, url, digest, size, is_copy, refers_to, date, copy), 0
    name = record_name(page, digest, copy)
    while True:
        piece = view[at:at + max(1, chunk - len(head))]
        so_far.update(piece)
        at += len(piece)
        last = at >= len(view)
        yield name, n, last, b"".join([head, piece, b"\r\n\r\n" if last else b""]), so_far.digest()
        if last:
            return
        n, head = n + 1, b""


def _write(date: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        rows, held = [], 0
        for batch in batches:
            html = batch.column("html")
            cols = [batch.column(n) for n in ("page_id", "url", "digest", "payload_bytes", "refers_to", "is_copy", "copy")]
            for k in range(batch.num_rows):
                page, url, digest, size, ref, is_copy, copy = (c[k].as_py() for c in cols)
                payload = memoryview(html[k].as_buffer()) if not is_copy and size else b""
                for row in record_chunks(page, url, payload, digest, size, ref, date, chunk, is_copy, copy):
                    rows.append(row)
                    held += len(row[3])
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _one_response(twins: DataFrame) -> DataFrame:
    """Of rows with equal ids and payloads one stays a response, the others revisit it. Payloads are combined
    before they are shuffled; the rows themselves travel without them."""
    key = ["page_id", "digest"]
    narrow = saved(twins.drop("html").withColumn("copy", F.monotonically_increasing_id() + 1), "twins")
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in key]
    chosen = narrow.groupBy(*key).agg(F.min("copy").alias("_chosen")).select(*[F.col(c).alias(f"_{c}") for c in key], "_chosen")
    others = narrow.join(chosen.select("_chosen"), F.col("copy") == F.col("_chosen"), "left_anti")
    others = others.withColumns({"html": F.lit(None).cast("string"), "is_copy": F.lit(True), "refers_to": F.col("page_id")})
    payloads = twins.groupBy(*key).agg(F.first("html").alias("html")).select(*[F.col(c).alias(f"_{c}") for c in key], "html")
    first = narrow.join(chosen.select("_chosen"), F.col("copy") == F.col("_chosen"), "left_semi").withColumn("copy", F.lit(0).cast("long"))
    return first.join(payloads, same[0] & same[1]).select(*first.columns, "html").unionByName(others.select(*first.columns, "html"))


def write_archive(pages: DataFrame, path: str, least: int = 0, page_id: str = "page_id", url: str = "url",
                  payload: str = "html", date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> None:
    """Write all pages as a chunk table at `path`. Payloads are joined with their plan by one shuffle
    and not sorted."""
    plan = saved(plan_records(pages, least, page_id, payload), "record-plan")
    own = pages.select(F.col(page_id).cast("long").alias("_page"), F.col(url).alias("url"), _payload(F.col(payload)).alias("html"),
                       _sha1(F.col(payload)).alias("_sha1"))
    joined = own.join(plan.hint("shuffle_hash"), F.col("_page").eqNullSafe(F.col("page_id")) & (F.col("_sha1") == F.col("digest")))
    columns = ["page_id", "url", F.when(~F.col("is_copy"), F.col("html")).alias("html"), "digest", "payload_bytes", "is_copy", "refers_to"]
    twin = (F.col("same") > 1) & ~F.col("is_copy") & (F.col("payload_bytes") >= least)
    number = F.when(F.col("same") > 1, F.monotonically_increasing_id() + 1).otherwise(0).cast("long").alias("copy")
    rows = joined.where(~twin).select(*columns, number)
    if not plan.where(twin).isEmpty():
        rows = rows.unionByName(_one_response(joined.where(twin).select(*columns)))
    rows.mapInArrow(_write(date, chunk), CHUNKS).write.option("compression", "zstd").parquet(path)


class RecordReader:
    """Reads one record from its chunks in order, with one chunk in memory."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.left = self.size = 0
        self.digest = hashlib.sha1()

    def feed(self, first: bool, data: bytes, so_far: bytes) -> None:
        at = 0
        if first:
            end = data.index(b"\r\n\r\n")
            version, *lines = data[:end].decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError(f"not a WARC/1.1 record: {version[:20]}")
            self.fields = dict(line.split(": ", 1) for line in lines if ": " in line)
            body = data.index(b"\r\n\r\n", end + 4) + 4
            self.left, at = int(self.fields["Content-Length"]) - (body - end - 4), body
        piece = memoryview(data)[at:at + self.left]
        self.digest.update(piece)
        self.left -= len(piece)
        self.size += len(piece)
        if self.digest.digest() != so_far:
            raise ValueError(f"damaged chunk in {self.fields.get('WARC-Record-ID')}")

    def row(self) -> tuple:
        f = self.fields
        if self.left:
            raise ValueError(f"record {f.get('WARC-Record-ID')} lacks {self.left} bytes")
        named = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and named != base32_sha1(self.digest.digest()):
            raise ValueError(f"record {f['WARC-Record-ID']} does not have its digest")
        page, ref = (None if x == "-" else int(x) for x in (f["WARC-Page-ID"], f.get("WARC-Refers-To-Page-ID", "-")))
        return page, self.size, named, f["WARC-Type"], ref


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    reader, expected = RecordReader(), 0
    for batch in batches:
        rows = []
        cols = [batch.column(n) for n in ("chunk_no", "last", "data", "sha1_so_far")]
        for k in range(batch.num_rows):
            n, last, data, so_far = (c[k].as_py() for c in cols)
            if n != expected:
                raise ValueError(f"chunk {expected} of a record is missing")
            reader.feed(n == 0, data, so_far)
            expected = n + 1
            if last:
                rows.append(reader.row())
                reader, expected = RecordReader(), 0
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)
    if expected:
        raise ValueError("the last record is not complete")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, every digest checked. Records of one chunk are parsed where they are read; the
    chunks of longer ones are brought together by record and sorted, and a task holds one at a time.
    Revisits get the payload size of the response with their digest."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    alone = (F.col("chunk_no") == 0) & F.col("last")
    fields = ["chunk_no", "last", "data", "sha1_so_far"]
    short = chunks.where(alone).select(*fields).mapInArrow(_read, PARSED)
    long_ones = chunks.where(~alone).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    records = saved(short.unionByName(long_ones.select(*fields).mapInArrow(_read, PARSED)), "records")
    copies = records.where("record_type = 'revisit'")
    counts = copies.groupBy("payload_digest").agg(F.count("*").alias("_rows"))
    responses = records.where("record_type = 'response'").join(counts, "payload_digest").select(
        "payload_digest", F.col("payload_bytes").alias("_full"), "_rows")
    found = join_unique(copies, responses, "payload_digest", "_rows", records.count())
    names = records.columns
    return records.where("record_type = 'response'").unionByName(found.withColumn("payload_bytes", F.col("_full")).select(*names))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM p
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM digests GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (payload_digest)
"""


@query("op3_warc", ORACLE)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)
