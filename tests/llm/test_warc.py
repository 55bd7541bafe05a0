import hashlib

import pytest
from pyspark.sql import functions as F

from atomflow.llm.warc import dechunk, read_archives, records_of, row_id, write_archives

SCHEMA = "page_id bigint, url string, html string, digest string, size int"


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("segment", [100, 1 << 20])
def test_round_trip(spark, tmp_path, segment, compression):
    big = "WARC/1.1\r\n\r\n0\r\n\r\né" * 200
    pages = [(1, "http://a b/\r\nx", "", "c", 1), (2, None, None, "c", 1), (3, "u", big, "c", 1), (4, "u", big, "c", 1), (9, "u", big, "c", 1), (5, "u", "small", "c", 1), (6, "u", "small", "c", 1)]
    pages += [(i, "u", "hot " * 400, "c", 1) for i in range(20, 60)] + [(None, "u", "x" * 2000, "c", 1), (7, "u", "y" * 300_000, "c", 1)]
    path = f"file://{tmp_path}/w"
    write_archives(spark.createDataFrame(pages, SCHEMA), path, segment=segment, chunk=37, archive=7 * (segment + 1024), compression=compression)
    got = {}
    for r in read_archives(spark, path).withColumns({"id": row_id(F.col("record_id")), "ref": row_id(F.col("refers_to"))}).collect():
        got.setdefault(r.id, []).append((r.type, r.ref, r.payload_bytes, r.payload_digest, r.payload))
    assert sum(map(len, got.values())) == len(pages)
    for i, _, html, *_ in pages:
        data = (html or "").encode()
        same = [p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None]
        last = max(same, default=None)
        ref = last if len(data) >= 1000 and i != last and i is not None else None
        assert got[i] == [("revisit" if ref else "response", ref, len(data), hashlib.sha1(data).hexdigest(), None if ref else data)]


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_archives(spark.createDataFrame([], SCHEMA), path)
    assert read_archives(spark, path).count() == 0


def test_broken_archives():
    with pytest.raises(ValueError):
        list(records_of(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
    assert dechunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_missing_segment(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab"
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-atomflow:1.0>\r\nWARC-Segment-Number: 1\r\nContent-Length: %d\r\n\r\n" % len(block)
    (tmp_path / "part-0").write_bytes(head.encode() + block + b"\r\n\r\n")
    with pytest.raises(Exception, match="segments|has .* bytes"):
        read_archives(spark, f"file://{tmp_path}").collect()


def test_archives_are_bounded_in_bytes_and_cut_records_come_back(spark, tmp_path):
    """Large pages make many archives of bounded size; the standing segment size sends common pages through reassembly."""
    pages = [(i, "u", f"{i} " + "p" * 700_000, "c", 1) for i in range(40)] + [(100 + i, "u", f"{i} " + "q" * 20_000, "c", 1) for i in range(30)]
    path = tmp_path / "w"
    write_archives(spark.createDataFrame(pages, SCHEMA).coalesce(1), f"file://{path}", archive=2 << 20, compression="none")
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    assert len(files) >= 14 and max(f.stat().st_size for f in files) <= 2 << 20
    records = [f for x in files for f, _ in records_of(x.read_bytes())]
    assert sum(f["warc-type"] == "continuation" for f in records) > 40 * 80
    got = {r.id: (r.payload_bytes, r.payload_digest) for r in read_archives(spark, f"file://{path}").withColumn("id", row_id(F.col("record_id"))).collect()}
    assert got == {i: (len(t), hashlib.sha1(t.encode()).hexdigest()) for i, _, t, *_ in pages}


def test_a_large_archive_is_read_record_by_record():
    """200 MB of records, as one gzip member and as many, without holding the plain archive."""
    import gzip
    import tracemalloc

    block = b"x" * 1_000_000
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for archive in (gzip.compress(record * 200, 1), gzip.compress(record, 1) * 200):
        tracemalloc.start()
        assert sum(len(b) for _, b in records_of(archive)) == 200_000_000
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
        tracemalloc.stop()
