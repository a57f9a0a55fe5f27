import gzip
import hashlib
import random

import pytest

from attestra.llm import warc


def test_round_trip(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(3, "http://a/x", long), (1, "http://b/\r\ny", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "z" * 200_000), (2, None, long), (9, "u", "a" * 99), (10, "u", "a" * 99)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, record_type string")
    got = [tuple(r) for r in warc.archive_round_trip(pages).collect()]
    assert len(got) == len(rows)
    digest = hashlib.sha256(long.encode()).hexdigest()
    held = [g for g in got if g[2] == digest]
    assert all(g[1] == len(long.encode()) for g in held) and sum(g[3] == "response" for g in held) == 1
    short = [g for g in got if g[1] < 100]
    assert all(g[3] == "response" and g[4] is None for g in short) and len(short) == 6
    assert [g[2] for g in got if g[0] == 7] == [hashlib.sha256(b"").hexdigest()]
    known = spark.createDataFrame([r for r in [(i, u, h) for i, u, h in rows] if r[0] is not None], "page_id long, url string, html string")
    again = {(g[0], g[3], g[4]) for g in (tuple(r) for r in warc.archive_round_trip(known).collect()) if g[2] == digest}
    assert again == {(1, "response", None), (2, "revisit", 1), (3, "revisit", 1)}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_transactions_are_nested(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "h" * 150), (2, "http://a/y", "h" * 150)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    t = {r["metadata_fields"]["page-id"]: r for r in warc.transactions(warc.read_records(spark, path)).collect()}
    assert t["1"]["request"]["target"] == "http://a/x" and t["1"]["capture"]["kind"] == "response"
    assert t["2"]["capture"]["kind"] == "revisit" and t["2"]["origin_page"] == "1" and t["2"]["origin_bytes"] == 150


def test_null_ids_come_last(spark):
    same = "p" * 150
    pages = spark.createDataFrame([(None, "n", same), (7, "s", same), (5, "f", same), (None, "only", "q" * 150), (None, "again", "q" * 150)], "page_id long, url string, html string")
    got = sorted(((r["target"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages.coalesce(1)).collect()), key=str)
    assert got == [("again", "revisit", None), ("f", "response", None), ("n", "revisit", 5), ("only", "response", None), ("s", "revisit", 5)]


def test_archives_are_read_in_pieces():
    rnd = random.Random(1)
    blocks = [rnd.randbytes(n) for n in (0, 5, 3_000_000, 17)]
    records = [f"WARC/1.1\r\nWARC-Type: x{k}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for k, b in enumerate(blocks)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [(h["warc-type"], b) for h, b in warc.parse(warc.inflated(data))] == [(f"x{k}", b) for k, b in enumerate(blocks)]
        with pytest.raises(ValueError):
            list(warc.parse(warc.inflated(data[: len(data) // 2])))
    assert list(warc.parse([])) == []


def test_a_payload_that_many_pages_share(spark):
    rows = spark.range(5000).selectExpr("id as page_id", "concat('http://h/', id) as url", "case when id % 3 = 0 then repeat('e', 200) else concat('page ', id, repeat('x', 120)) end as html")
    got = warc.archive_round_trip(rows).collect()
    assert len(got) == 5000
    assert all((r["record_type"], r["refers_to"]) == (("revisit", 0) if r["page_id"] % 3 == 0 and r["page_id"] else ("response", None)) for r in got)
    assert all(r["target"] == r["request_target"] == f"http://h/{r['page_id']}" for r in got)


def test_archives_are_bounded_by_running_bytes(spark, tmp_path):
    """Many tiny pages before a few large ones: no archive outgrows the bound by
    more than one record, none is empty, and all pages are read back."""
    size = "case when id < 4000 then 1 else 300000 end"
    pages = spark.range(0, 4060, 1, 1).selectExpr("id as page_id", "concat('http://h/', id) as url", f"concat(id, repeat('x', {size})) as html")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, 1 << 20)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").rglob("*.gz")]
    assert min(sizes) > 0 and max(sizes) <= (1 << 20) + 301_000 and len(sizes) >= 18
    got = warc.transactions(warc.read_records(spark, path)).select("metadata_fields").collect()
    assert sorted(int(r[0]["page-id"]) for r in got) == list(range(4060))
    warc.write_archives(pages.where("page_id = 4059"), f"{path}1", 1000)
    (whole,) = [f for f in (tmp_path / "w1").rglob("*.gz") if len(gzip.decompress(f.read_bytes())) > 1000]
    assert warc.read_records(spark, f"{path}1").count() == 3 and whole
