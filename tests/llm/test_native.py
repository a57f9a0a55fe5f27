import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

from attestra.llm import sharding, url_filters
from attestra.llm.queries import ORACLES, QUERIES
from verify import rows_of


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, db, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows_of(got, columns) == rows_of(want, columns)


def bits(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def brute_shards(rows, limit):
    size = [(k, len((t or "").encode())) for k, t in rows]
    sums = defaultdict(int)
    for k, n in size:
        if n <= limit:
            for d in range(61):
                sums[d, bits(k) >> (60 - d)] += n
    out = []
    for k, n in size:
        d = 60 if n > limit else next(d for d in range(61) if sums[d, bits(k) >> (60 - d)] <= limit)
        out.append((k, n, d, bits(k) >> (60 - d)))
    return out


def test_sharding_against_brute_force(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(400)] + [(1000, "y" * 5000), (1001, None), (1002, ""), (None, "z" * 10)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, depth int")
    for limit in (1000, 4000, 10**9):
        got = sharding.shards(docs, "doc_id", "text", limit).collect()
        assert sorted(map(str, [(r["doc_id"], r["n_bytes"], r["depth"], r["prefix"]) for r in got])) == sorted(map(str, brute_shards(rows, limit)))
        for r in got:
            assert r["shard_bytes"] <= limit or r["shard_rows"] == 1
    assert sharding.shards(docs.where("false"), "doc_id", "text", 1000).count() == 0


def test_a_hot_key_is_spread(spark, tmp_path):
    docs = spark.createDataFrame([(7, "x" * 100)] * 300 + [(i, "y" * 100) for i in range(100, 200)], "doc_id long, text string")
    got = sharding.shards(docs, "doc_id", "text", 2000).collect()
    assert len(got) == 400 and all(r["shard_bytes"] <= 2000 for r in got)
    held = Counter((r["depth"], r["prefix"], r["spread"]) for r in got)
    assert all(n * 100 <= 2000 for n in held.values()) and sum(r["spread"] for r in got) >= 300
    sharding.write_shards(docs.where("doc_id != 7"), "doc_id", "text", str(tmp_path / "s"), 2000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_written_shards_hold_every_row_and_keep_to_the_limit(spark, tmp_path):
    rows = [(5, "b" * 3000, "x"), (5, "c" * 3000, "y"), (None, "n" * 10, "z"), (None, None, "w"), *[(7, "x" * 100, str(k)) for k in range(60)], *[(i, "y" * 100, "o") for i in range(100, 200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string")
    sharding.write_shards(docs, "doc_id", "text", str(tmp_path / "s"), 2000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    held = Counter()
    for r in spark.read.parquet(str(tmp_path / "s")).selectExpr("shard_ as s", "coalesce(octet_length(text), 0) as n").collect():
        held[r["s"]] += r["n"]
    assert sorted(held.values())[-2:] == [3000, 3000] and all(n <= 2000 or n == 3000 for n in held.values())


URLS = [
    (1, "http://A.Example.org/es/x?y"), (2, "https://example.org/en/12"), (3, "http://b.org"), (4, "http://b.org/"), (5, "x://com/de/1"), (6, "http://q.com/fr/"), (7, None), (8, "nothing"), (9, "http:///p"),
    (10, "http://xorg/"), (11, "http://h.net/a#b"), (12, "http://É.net?x://y/"), (2, "https://example.org/en/12"), (None, "http://h.net/"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in URLS], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(11, 0), (12, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, labels).collect()]
    want = {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("b.org", "", None, "allow"), 4: ("b.org", "/", "org/", "allow"),
        5: ("com", "/de/1", "com/de/", "block"), 6: ("q.com", "/fr/", "com/fr/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "/p", None, "allow"), 10: ("xorg", "/", None, "allow"),
    }
    assert len(got) == len(URLS)
    for i, *rest in got:
        if i in want:
            assert tuple(rest) == want[i]
    assert [r[1] for r in got if r[0] == 12] == ["É.net"]
    assert url_filters.judge(pages.where("false"), labels.where("false")).count() == 0


def test_a_bad_host_is_blocked_and_a_good_one_is_not(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 4 == 0 else 'good' if i % 4 == 1 else f'h{i}'}.example.net/p") for i in range(800)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 or i % 29 == 0 else 1) for i in range(800)], "doc_id long, quality int")
    got = {r["host"]: r["verdict"] for r in url_filters.judge(pages, labels).collect()}
    assert got["bad.example.net"] == "block" and got["good.example.net"] == "allow"
    assert sum(v == "block" for v in got.values()) < 60


def test_domains(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("www.a.example.com",), ("example.com",), ("x.y.zz",), ("zz",), ("",)], "h string")
    s = url_filters.suffix_of(F.col("h"))
    got = [tuple(r) for r in rows.select(s, url_filters.domain_of(F.col("h"), s)).collect()]
    assert got == [("example.com", "a.example.com"), ("example.com", "example.com"), ("zz", "y.zz"), ("zz", "zz"), ("", "")]
    assert math.isclose(url_filters.MOST_RHO, 0.5)


def test_suffix_rules(spark):
    from pyspark.sql import functions as F

    want = {"a.b.co.uk": "co.uk", "co.uk": "co.uk", "x.y.ck": "y.ck", "www.ck": "ck", "a.www.ck": "ck", "ck": "ck", "b.example.org": "example.org", "uk": "uk"}
    rows = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r[0]: r[1] for r in rows.select("h", url_filters.suffix_of(F.col("h"))).collect()} == want
