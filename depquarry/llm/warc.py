"""WARC archives: writing with revisits, segments and chunked framing, and reading back by segment reassembly.

Writing: a page's payload (the html in UTF-8) becomes an HTTP response block in chunked transfer framing; a block of
over ``SEGMENT_BYTES`` is cut into a first record and continuation records that name it. Of records with equal payloads
of ``REVISIT_BYTES`` or more, that with the largest page_id is a response, the others are revisits without payload.
Reading: continuation records are grouped by their origin's identifier, ordered by segment number, checked against the
stated total length, and the chunked framing is decoded; digest and length are checked against the record's header.

Archives are written and listed by Spark (gzip text files whose rows end in the record terminator), so any store that
Spark reaches will do. A record holds ``segment_bytes`` of block at most and a file ``RECORDS_PER_FILE`` records or
``FILE_BYTES`` of blocks, whichever is less; a reading task holds one file, compressed, and streams through it. What
becomes a revisit is decided on digests alone; payloads are shuffled only where the list of revisits is too long to
broadcast (``MAX_BROADCAST_BYTES``), and then by page, never by payload.

Null html counts as empty; null urls have no target URI. Repeated rows are repeated records, with identifiers of their
own; archives by others in which equal records share an identifier are read as well. Of equal payloads with a tie for the largest page_id, each
of the tied rows is a response. Null page ids are archived without one and never revisited. An empty table makes an
empty archive and no rows. Extra columns are ignored. A broken archive is an error, never a missing row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_type, map_batches, scratch_path, struct, table, written

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES, RECORDS_PER_FILE = 32 << 10, 8 << 10, 1000, 2000
FILE_BYTES, MAX_BROADCAST_BYTES = 64 << 20, 32 << 20
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, a broken frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block


def record_id(page_id: int | None, url: str | None, digest: str, copy: int | None = None) -> str:
    """The identifier of a page's record; ``copy`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{digest}\n{url}' + ('' if copy is None else f'\n{copy}'))}>"


def _uri(url: str | None) -> str | None:
    return url and url.replace("\r", "%0D").replace("\n", "%0A")


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, refers_known: bool = False, copy: int | None = None, segment: int = SEGMENT_BYTES, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The WARC records of one page; a revisit names the record it refers to where that is one of a kind (``refers_known``)."""
    digest = hashlib.sha1(payload).hexdigest()
    name, uri = record_id(page_id, url, digest, copy), _uri(url)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        original = [("WARC-Refers-To", record_id(refers_to, refers_url, digest) if refers_known else None), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", DATE)]
        yield _record([*fields, ("WARC-Profile", _PROFILE), *original, ("X-Refers-To-Page-ID", refers_to)], _HTTP)
        return
    block = _HTTP + chunked(payload, size)
    if len(block) <= segment:
        yield _record(fields, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}{n}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n)]
        yield _record(more + ([("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []), part)


def _marks(rows: DataFrame) -> DataFrame:
    """(page_id, sha, refers_to, refers_url, refers_known, repeated) of the revisits and the repeated rows, by digests alone."""
    keys = rows.filter((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("page_id", "sha", "n").agg(F.count("*").alias("c"), F.max("url").alias("url"))
    keys = written(keys, "digests")
    tops = keys.groupBy("sha", "n").agg(F.max(F.struct("page_id", "c", "url")).alias("top"), F.sum("c").alias("copies")).filter("copies > 1").select("sha", "n", "top")
    found = keys.join(tops, ["sha", "n"]).select("page_id", "sha", F.when(F.col("page_id") < F.col("top.page_id"), F.col("top.page_id")).alias("refers_to"), F.col("top.url").alias("refers_url"), (F.col("top.c") == 1).alias("refers_known"), (F.col("c") > 1).alias("repeated"))
    return written(found.filter("refers_to is not null or repeated"), "marks")


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumns({"sha": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    marks = _marks(rows)
    size = marks.agg(F.sum(F.coalesce(F.octet_length("refers_url"), F.lit(0)) + 64)).first()[0] or 0
    marked = rows.join(F.broadcast(marks) if size <= max_broadcast_bytes else marks.hint("merge"), ["page_id", "sha"], "left")
    marked = marked.select("page_id", "url", "payload", "refers_to", "refers_url", F.coalesce("refers_known", F.lit(False)), F.when(F.col("repeated"), F.monotonically_increasing_id()))
    per_file = max(1, min(records_per_file, FILE_BYTES // segment_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in range(batch.num_rows):
                for r in records_of(*(batch.column(i)[row].as_py() for i in range(7)), segment_bytes, chunk_bytes):
                    held.append(r)
                    size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    records = marked.mapInArrow(run, struct(value="binary"))
    records.select(F.col("value").cast("string")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


SEGMENTS = struct(origin="string", page_id="long", url="string", record_type="string", refers_to="long", number="int", total="long", payload_bytes="long", payload_digest="string", block="binary", payload="binary")


def _checked(payload: bytes, n: int, digest: str) -> bytes:
    if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its header's length or digest")
    return payload


def _body(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _segment(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    number = fields.get("warc-segment-number")
    if fields["warc-type"] == "continuation":
        total = fields.get("warc-segment-total-length")
        return fields["warc-segment-origin-id"], None, None, None, None, int(number), total and int(total), None, None, block, None
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    n, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    whole = number is None
    payload = _checked(_body(block), n, digest) if whole and fields["warc-type"] == "response" else None
    return fields["warc-record-id"], page and int(page), fields.get("warc-target-uri"), fields["warc-type"], refers and int(refers), None if whole else int(number), None, n, digest, None if whole else block, payload if with_payload else None


def reassembled(numbers: list[int], blocks: list[bytes], total: int) -> tuple[bytes, int]:
    """The block out of its segments in any order, and how many equal copies of it there are."""
    counts = Counter(numbers)
    if sorted(counts) != list(range(1, len(counts) + 1)) or len(set(counts.values())) != 1:
        raise ValueError("a segment is missing")
    block = b"".join(dict(sorted(zip(numbers, blocks))).values())
    if len(block) != total:
        raise ValueError(f"segments hold {len(block)} bytes, {total} were stated")
    return block, counts[1]


PAGES = struct(page_id="long", url="string", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long", payload="binary")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): a row per record, continuations put together."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = SEGMENTS.names, [arrow_type(f.dataType) for f in SEGMENTS]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], names=names)
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as f:
                    for fields, block in parse_records(io.BufferedReader(f, 1 << 20)):
                        rows.append(_segment(fields, block, with_payload))
                        size += len(block)
                        if size > 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(parse, SEGMENTS)
    first = [F.max(c).alias(c) for c in ("page_id", "url", "record_type", "refers_to", "total", "payload_bytes", "payload_digest", "payload")]
    grouped = parts.groupBy("origin").agg(*first, F.count("*").alias("n"), F.collect_list("number").alias("numbers"), F.collect_list("block").alias("blocks"))

    def join(batch: pa.RecordBatch) -> dict:
        rows = []
        for r in range(batch.num_rows):
            get = lambda c: batch.column(c)[r].as_py()
            numbers, copies, payload = get("numbers"), get("n"), get("payload")
            if numbers:
                block, copies = reassembled(numbers, get("blocks"), get("total"))
                payload = _checked(_body(block), get("payload_bytes"), get("payload_digest"))
            rows += [(get("page_id"), get("url"), get("payload_bytes"), get("payload_digest"), get("record_type"), get("refers_to"), payload if with_payload else None)] * copies
        return dict(zip(PAGES.names, map(list, zip(*rows))))

    return map_batches(grouped, join, PAGES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d FROM p),
t AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY d, n) END AS top FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM t
"""
