"""WARC archives of pages: writing with segments and revisits, reading with reassembly.

Writing: each page becomes a response record whose block is an HTTP message with chunked
transfer framing, or, when its payload repeats that of a page with a larger id and has at
least ``min_revisit`` bytes, a revisit record that refers to it. Blocks longer than
``segment`` bytes are cut: the first segment keeps the record's type, the rest are
continuation records that name the origin, their number and, in the last one, the total
length. Archives are WARC 1.1 files, compressed with gzip as a whole, that Spark's own text writer puts into the given
folder (a record ends in CR LF CR LF, which is the writer's line separator), so they can lie
in any store that Spark reaches and are committed as a whole. Since no record is longer than a segment and its header, a number of records
bounds an archive's bytes, whatever the pages' sizes are. Payloads aren't shuffled: the digests that several pages share are looked up, by broadcast
while they are few enough.

Reading: each archive is decompressed and parsed record by record, by its Content-Length fields, so a task holds one compressed archive and
one record; archives whose records are gzip members of their own are read alike (Spark's binary reader takes files below 2 GB). The segments of a record are grouped by
the identifier of their origin, ordered by number and checked against the total
length; the chunked framing is undone, and the payload's SHA-1 is checked against the header. A
group is the segments of one record, so it is as large as one page. Any violation
raises.

Defined results: a null page is an empty one. Rows that repeat a page_id are kept as separate
records, told apart by a number in the record's identifier; a page_id may be null. Only the columns for id, url and
payload are read, so others may have any names. Pages of any length are written whole. Of equal payloads with equal largest ids all are responses.
An empty table gives archives without records, and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomflow.llm.scratch import small_side, stored

CRLF = "\r\n"
#: Bytes of a record's block that stay in one segment.
SEGMENT = 8 * 1024
CHUNK = 4 * 1024
#: Bytes of an archive before compression, about; segments bound its records, so the number of records bounds its bytes.
ARCHIVE = 32 << 20
#: Bytes of a record's header that archives are reckoned with.
HEADER = 1024
_ID = "urn:x-atomflow:"


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Pages with the SHA-1 of their payload, and for revisits the id of the response that they repeat.

    Of equal payloads the largest id is the response. The groups are reduced per task before the
    shuffle, and only those of several pages are joined back.
    """
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    groups = (
        base.filter(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    same = base.join(small_side(stored(groups, "repeated")), ["digest", "size"], "left")
    return same.select("page_id", "url", "payload", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _blocks(batches: Iterator[pa.RecordBatch], segment: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Records of the pages, without the separator that ends each."""
    for batch in batches:
        out: list[bytes] = []
        held = 0
        for i, row in enumerate(batch.to_pylist()):
            payload, n, ref = row["payload"], row["size"], row["refers_to"]
            url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "urn:x-atomflow:none")
            own = f"<{_ID}{'null' if row['page_id'] is None else row['page_id']}.{row['nr']}>"
            head = [
                "WARC/1.1", f"WARC-Record-ID: {own}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
                f"WARC-Payload-Digest: sha1:{row['digest']}",
            ]
            http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
            if ref is not None and row["refers_to"] != row["page_id"]:
                head += ["WARC-Type: revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{ref}>"]
                block = f"{http}Content-Length: {n}{CRLF}{CRLF}".encode()
            else:
                head += ["WARC-Type: response"]
                body = b"".join(b"%x\r\n%b\r\n" % (min(chunk, n - at), payload[at : at + chunk]) for at in range(0, n, chunk)) + b"0\r\n\r\n"
                block = f"{http}Transfer-Encoding: chunked{CRLF}{CRLF}".encode() + body
            head += ["Content-Type: application/http; msgtype=response"]
            parts = [block[at : at + segment] for at in range(0, len(block), segment)]
            for k, part in enumerate(parts, 1):
                h = head if k == 1 else ["WARC/1.1", f"WARC-Record-ID: {own[:-1]}.{k}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "WARC-Type: continuation", f"WARC-Segment-Origin-ID: {own}"]
                if len(parts) > 1:
                    h = [*h, f"WARC-Segment-Number: {k}"]
                    if k == len(parts):
                        h.append(f"WARC-Segment-Total-Length: {len(block)}")
                out.append(CRLF.join([*h, f"Content-Length: {len(part)}", "", ""]).encode() + part)
                held += len(part)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(
    pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, archive: int = ARCHIVE, compression: str = "gzip", **names: str
) -> None:
    """Writes the archives of pages into a new folder, each of about so many bytes at most; compression: gzip, for each file as a whole, or none."""
    rows = classified(pages, **names).withColumn("nr", F.monotonically_increasing_id())
    records = rows.mapInArrow(lambda it: _blocks(it, segment, chunk), "record binary")
    per_file = max(1, archive // (segment + HEADER))
    records.select(F.col("record").cast("string")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record starts here: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}


def records_of(archive: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, plain or compressed with gzip in one member or several; one record is held at a time."""
    stream = pa.BufferReader(archive)
    plain = bytes(archive[:2]) != b"\x1f\x8b"
    read = io.BufferedReader(stream if plain else gzip.GzipFile(fileobj=stream), 1 << 16)
    while first := read.readline():
        head = first
        while (line := read.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record's header doesn't end")
            head += line
        fields = _fields(head.removesuffix(b"\r\n"))
        n = int(fields["content-length"])
        block, end = read.read(n), read.read(4)
        if len(block) != n or end != b"\r\n\r\n":
            raise ValueError(f"the block of {fields.get('warc-record-id')} isn't {n} bytes long")
        yield fields, block


def dechunk(body: bytes) -> bytes:
    """A body without its chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its length says")
        out.append(body[at : at + n])
        at += n + 2


_PARSED = "origin string, number int, total bigint, type string, uri string, digest string, refers_to string, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for f, block in records_of(content.as_buffer()):
                if f["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                total = f.get("warc-segment-total-length")
                rows.append((
                    f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]) if "warc-segment-number" in f else None, int(total) if total else None,
                    f["warc-type"], f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), block,
                ))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_WHOLE = "record_id string, type string, uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def payload_of(kind: str, block: bytes) -> tuple[bytes | None, int]:
    """The decoded payload of an HTTP block and its length; of a revisit only the length is there."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return None, int(fields[b"content-length"])
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunk(body)
    elif b"content-length" in fields:
        body = body[: int(fields[b"content-length"])]
    return body, len(body)


def _decode(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["number"] or 1)
            if len(parts) > 1 or parts[0]["number"] is not None:
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"segments of {r['origin']} are missing: {[p['number'] for p in parts]}")
                size = sum(len(p["block"]) for p in parts)
                if parts[-1]["total"] != size:
                    raise ValueError(f"{r['origin']} has {size} bytes in its segments, not {parts[-1]['total']}")
            first = parts[0]
            payload, n = payload_of(first["type"], b"".join(p["block"] for p in parts))
            digest = (first["digest"] or "").removeprefix("sha1:")
            if payload is not None and digest and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {r['origin']} has another digest than its header says")
            if payload is not None:
                digest = hashlib.sha1(payload).hexdigest()
            rows.append((r["origin"], first["type"], first["uri"], first["refers_to"], n, digest, payload if keep else None))
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _WHOLE.split(", ")])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit: record_id, type, uri, refers_to, payload_bytes, payload_digest, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInArrow(_parse, _PARSED)
    part = F.struct("number", "total", "type", "uri", "digest", "refers_to", "block")
    alone = parsed.filter("number IS NULL").select("origin", F.array(part).alias("parts"))
    cut = parsed.filter("number IS NOT NULL").groupBy("origin").agg(F.collect_list(part).alias("parts"))
    return alone.unionByName(cut).mapInArrow(lambda it: _decode(it, payloads), _WHOLE)


def row_id(record_id: Column) -> Column:
    """The page_id in a record's identifier; null if the page had none."""
    return F.regexp_extract(record_id, r"^<urn:x-atomflow:(-?\d+)[.>]", 1).try_cast("bigint")
