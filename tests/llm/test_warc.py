import base64
import gzip
import hashlib
from pathlib import Path

from cinegraph.llm import warc

ROWS = [
    (1, "http://a/1", "<p>one</p>", "x"),
    (2, "http://a/2", "<p>one</p>", "x"),
    (9, None, "<p>one</p>", "x"),
    (4, "http://a/\r\nX:\t1\x7f", "with\r\n\r\nWARC/1.1\r\nblank lines é", "x"),
    (5, "", None, "x"),
    (6, "http://a/6", "", "x"),
    (None, "http://a/7", "<p>one</p>", "x"),
    (None, "http://a/8", "alone", "x"),
    (10, "http://a/10", "twice", "x"),
    (10, "http://a/10", "twice", "x"),
    (3, "http://a/3", "z" * 300_000, "x"),
] + [(100 + i, f"http://b/{i}", "hot payload", "x") for i in range(500)]


def test_revisits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    got = {}
    for r in warc.round_trip(pages, str(tmp_path / "w")).collect():
        got.setdefault(r.page_id, []).append(tuple(r)[1:])
    b32 = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[9] == [(10, b32("<p>one</p>"), "response", None)]
    assert got[1] == got[2] == [(10, b32("<p>one</p>"), "revisit", 9)]
    assert got[5] == [(0, b32(""), "revisit", 6)] and got[6] == [(0, b32(""), "response", None)]
    assert got[4][0][2] == "response"
    assert sorted(x[2] for x in got[None]) == ["response", "revisit"]
    assert [x[2] for x in got[10]] == ["response", "response"]
    assert all(got[100 + i] == [(11, b32("hot payload"), "revisit", 599)] for i in range(499))
    again = warc.read(spark, str(tmp_path / "w"), with_payload=True).where("page_id = 4").collect()[0]
    assert bytes(again.payload).decode() == ROWS[3][2] and again.url == "http://a/%0D%0AX:%091%7F"
    stored = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("*.gz"))
    assert b"WARC-Date: 20" in stored and b"2024-01-01" not in stored
    assert stored.count(b"hot payload") == 1 and stored.count(b"WARC-Type: revisit") > 499


def test_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string, digest string")
    assert {r.record_type for r in warc.round_trip(pages, str(tmp_path / "w"), min_payload=11).collect()} == {"response"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, str(tmp_path / "w")).count() == 0
