"""Queries against their SQL on rows that the driver's small tables lack."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from attestra.operators import retrieval as Q
from attestra.plans.catalogue import ORACLES, QUERIES
from verify import rows_of


@pytest.fixture
def held_against_sql(spark, tmp_path):
    """A function that runs a query and its SQL over given rows of a table."""

    def run(name, table, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        db = duckdb.connect()
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = db.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows_of(got, columns) == rows_of(want, columns)
        return got

    return run


@pytest.mark.parametrize("name", ["src09_page_fields", "xml01_headings"])
def test_references_of_pages_are_resolved_as_in_the_sql(held_against_sql, name):
    texts = ["a&amp", "a&amp;b &amp; c", "&quot;x&quot; 'y' &#39;z", "&amp;amp; &amp;quot;", "&", "& &a &am", "&lt;b&gt; &eacute &copy;", " plain \n text "]
    html = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>&amp;</p></body></html>"
    got = held_against_sql(name, "pages", "page_id long, url string, html string", [(k, "u", html.format(t)) for k, t in enumerate(texts)])
    assert len(got) == len(texts) * (2 if name == "src09_page_fields" else 1)


def test_texts_without_words_have_no_buckets(held_against_sql):
    texts = ["", None, "...", "ä ß é", "İstanbul aİb", "Kelvin", "a a b", " 12 "]
    got = held_against_sql("idx01_feature_hashing", "documents", "doc_id long, text string", list(enumerate(texts)))
    assert set(got["doc_id"]) == {4, 5, 6, 7}


def test_embeddings_against_a_plain_sum(spark):
    """Length 1 for every text, and no sum over the whole width for each entry."""
    texts = ["", "a", "a b a", "uno dos tres cuatro cinco", " ".join(f"w{k}" for k in range(300))]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = Q.embedded(frame, "k", F.split("text", " "), 64)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: r.embedding for r in out.collect()}
    for k, t in enumerate(texts):
        v = [0] * 64
        for w in t.split(" "):
            marked = f"^{w}$"
            for f in ["w:" + w, *("c3:" + marked[i : i + 3] for i in range(len(w)))] if w else ["<empty>"]:
                h = hashlib.sha256(f.encode()).hexdigest()
                v[int(h[:8], 16) % 64] += 1 if int(h[8:10], 16) % 2 else -1
        norm = math.sqrt(sum(x * x for x in v))
        assert norm > 0 and got[k] == pytest.approx([x / norm for x in v], abs=1e-12)


def test_language_words_are_found_in_one_pass(spark, held_against_sql):
    """One expression over the text for all words, with the SQL's edges of words."""
    texts = ["the", "The AND\nof\n", "\nthe\n", "the_ _and of1", "èthe", "the÷ and×of", "ßthe", "İthe andİ", "der-und,die. le/et pour", "", None, "que  los\tdel the the", "LE ET", "x" * 50 + " die"]
    got = held_against_sql("str09_weighted_score", "documents", "doc_id long, text string", list(enumerate(texts)))
    assert got["en"].max() == 1 and len(got) == len(texts)
    plan = QUERIES["str09_weighted_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("regexp_replace") == 1
