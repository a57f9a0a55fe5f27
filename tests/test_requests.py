"""Functions in SQL, requests that come twice, files that arrive."""

import random

import pytest
from pyspark.sql import functions as F

from attestra import corpus, sql
from attestra.operators import extraction as E
from attestra.sources import workbook
from attestra.streaming import requests as R


def test_chunks_in_sql_equal_the_function(spark, small):
    assert "paragraph_chunks" in sql.register(spark)
    spark.read.parquet(f"{small}/documents.parquet").createOrReplaceTempView("docs_of_test")
    got = spark.sql("SELECT d.doc_id, c.ordinal, c.char_start, c.char_end, c.text FROM docs_of_test d, LATERAL paragraph_chunks(d.text) c")
    want = E.paragraph_chunks(spark.table("docs_of_test").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want.select("document_id", "ordinal", "char_start", "char_end", "text")) and got.count() > 100


def test_cells_in_sql_equal_the_function(spark):
    sql.register(spark)
    books = spark.createDataFrame([("a", corpus.dossier("INN-2025-041").files["horas.xlsx"]), ("b", b"no book"), ("c", None)], "document_id string, content binary")
    books.createOrReplaceTempView("books_of_test")
    got = spark.sql("SELECT b.document_id, c.* FROM books_of_test b, LATERAL workbook_cells(b.content) c")
    have = books.where("content IS NOT NULL")
    cells = workbook.workbook_cells(have)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(got.where("status IS NULL").drop("status", "reason")) == rows(cells)
    assert {r.document_id: r.status for r in got.where("status IS NOT NULL").collect()}.items() >= {r.document_id: r.status for r in workbook.workbook_status(have).collect()}.items()
    assert rows(workbook.workbook_contents(have).where("status IS NULL").drop("status", "reason")) == rows(cells)


def test_scalars_in_sql(spark):
    sql.register(spark)
    r = spark.sql("SELECT content_hash(cast('a' AS BINARY)) h, storage_key(repeat('ab', 32)) k, row_amount(8, 31.505) a, differs(1.00, 1.02) d, month_start('2025-02') m, month_start('x') n, reciprocal_rank(1, NULL) r").first()
    assert r.h.startswith("ca978112") and r.k.startswith("ab/ab/abab") and str(r.a) == "252.0400" and r.d and str(r.m) == "2025-02-01" and r.n is None and abs(r.r - 1 / 61) < 1e-12


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def brute(rows):
    held, out = {}, []
    for key, endpoint, seq, action, fingerprint in sorted(rows, key=lambda r: r[2]):
        told, now = R.outcome(held.get((key, endpoint)), action, fingerprint)
        held[key, endpoint] = now
        out.append((key, endpoint, seq, action, told))
    return sorted(out)


def test_outcomes():
    assert R.outcome(None, "RESERVE", "x") == ("RESERVED", ("x", "IN_FLIGHT"))
    assert R.outcome(("x", "IN_FLIGHT"), "RESERVE", "x")[0] == "IN_FLIGHT" and R.outcome(("x", "DONE"), "RESERVE", "x")[0] == "REPLAYED"
    assert R.outcome(("x", "DONE"), "RESERVE", "y")[0] == "CONFLICT" and R.outcome(("x", "IN_FLIGHT"), "RELEASE", None) == ("RELEASED", None)
    assert R.outcome(("x", "DONE"), "RELEASE", None) == ("IGNORED", ("x", "DONE")) and R.outcome(None, "COMPLETE", None) == ("IGNORED", None)


def test_stream_equals_table_and_brute_force(rocks, tmp_path):
    rng = random.Random(3)
    form = "key string, endpoint string, seq bigint, action string, fingerprint string"
    rows = [(f"k{rng.randrange(12)}", rng.choice(["a", "b"]), k, rng.choice(["RESERVE", "RESERVE", "COMPLETE", "RELEASE"]), rng.choice(["x", "x", "y"])) for k in range(240)]
    got = R.idempotent_requests(rocks.createDataFrame(rows, form))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    for part in range(3):  # the same, in three batches
        rocks.createDataFrame(rows[80 * part : 80 * part + 80], form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = R.idempotent_requests(rocks.readStream.schema(form).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, rocks.read.parquet(f"{tmp_path}/out").collect())) == brute(rows)
    assert {r[4] for r in brute(rows)} == {"RESERVED", "REPLAYED", "CONFLICT", "IN_FLIGHT", "COMPLETED", "RELEASED", "IGNORED"}


def test_files_arrive_once(spark, tmp_path):
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "a").mkdir(parents=True)
    (folder / "a" / "one.pdf").write_bytes(corpus.pdf("one"))
    (folder / "a" / "notes.txt").write_bytes(b"notes")
    R.take_arrivals(spark, str(folder), out, at)
    (folder / "a" / "two.png").write_bytes(corpus.png("two"))
    (folder / "b").mkdir()
    (folder / "b" / "broken.pdf").write_bytes(b"%PDF-1.7\ntruncated")
    R.take_arrivals(spark, str(folder), out, at)
    R.take_arrivals(spark, str(folder), out, at)
    got = sorted((r.path.rpartition("/")[2], r.status) for r in spark.read.parquet(out).collect())
    assert got == [("broken.pdf", "CORRUPT"), ("notes.txt", "UNSUPPORTED"), ("one.pdf", "RECEIVED"), ("two.png", "RECEIVED")]
    assert all(r.reason for r in spark.read.parquet(out).where("status != 'RECEIVED'").collect())
