import base64
import gzip
import hashlib

from pyspark.sql import functions as F
from skew import final_plan, skewed

from barloom.llm import warc
from barloom.llm._common import Scratch

SCHEMA = "page_id long, url string, html string, extra string"


def expected(rows, min_bytes=0):
    out = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in rows if p is not None and (h or "").encode() == payload]
        first = min(same) if same and len(payload) >= min_bytes and page_id is not None else page_id
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "x" * 1000, "e"),
    (2, "http://b/\r\nX: y", "x" * 1000, "e"),
    (3, None, None, None),
    (4, "http://d/", "", "e"),
    (5, "http://e/", "é漢🙂\r\n\r\nWARC/1.1\r\n", "e"),
    (None, "http://f/", "x" * 1000, "e"),
    (7, "http://g/", "y", "e"),
    (8, "http://h/", "y", "e"),
    (8, "http://h/", "y", "e"),
]


def test_round_trip_and_revisits(spark):
    for min_bytes in (0, 10):
        chunks = warc.round_trip(spark, spark.createDataFrame(ROWS, SCHEMA), min_bytes, chunk_bytes=7)
        got = sorted((tuple(r) for r in warc.summaries(chunks).collect()), key=repr)
        assert got == expected(ROWS, min_bytes)


def test_chunks_carry_running_digests_and_stay_small(spark):
    chunks = warc.round_trip(spark, spark.createDataFrame(ROWS[:2] + ROWS[4:5], SCHEMA), chunk_bytes=64).collect()
    assert max(len(c["data"]) for c in chunks) <= 64
    by = {}
    for c in sorted(chunks, key=lambda c: (c["archive"], c["record_no"], c["chunk_no"])):
        sha1 = by.setdefault((c["archive"], c["record_no"]), hashlib.sha1())
        sha1.update(c["data"])
        assert c["sha1_so_far"] == base64.b32encode(sha1.digest()).decode()
        if c["last"] and c["record_type"] == "response":
            assert c["sha1_so_far"] == c["declared_sha1"] and c["bytes_so_far"] == c["declared_bytes"]
    assert sum(c["record_type"] == "response" and c["page_id"] == 1 for c in chunks) == 16


def test_empty_table(spark):
    assert warc.summaries(warc.round_trip(spark, spark.createDataFrame([], SCHEMA))).count() == 0


def test_broken_archive_is_an_error(tmp_path):
    path = tmp_path / "a.warc.gz"
    writer = warc.ArchiveWriter(f"file://{tmp_path}", "b")
    writer.add(warc.record_parts(1, "u", b"abc" * 100, None))
    writer.close()
    whole = (tmp_path / "b-00000.warc.gz").read_bytes()
    assert gzip.decompress(whole).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    path.write_bytes(whole[: len(whole) // 2])
    try:
        list(warc.chunks_of(f"file://{path}"))
    except ValueError:
        return
    raise AssertionError("a cut archive was read")


def test_hot_payload_is_split(spark):
    """70 % of all pages have one payload: neither join has them all in one task."""
    rows = [(i, f"http://h/{i}", "hot" if i % 10 < 7 else f"page {i}", "e") for i in range(4000)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(8)
    with skewed(spark):
        scratch = Scratch(spark, "test")
        assert warc.revisits(pages, scratch).count() == 2799
        ids, first = (spark.read.parquet(scratch.path(x)) for x in ("digests", "firsts"))
        rows, plan = final_plan(ids.join(first, "_sha1"))
        assert len(rows) == 2800 and "skew=true" in plan
        _, plan = final_plan(warc.record_types(pages, Scratch(spark, "test")))
        assert "hashpartitioning(page_id" in plan
