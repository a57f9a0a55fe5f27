import hashlib
import random
import re

import pyarrow as pa

from attestra.llm import decontaminate as d
from attestra.llm.common import byte_slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w = brute_words(text)
    hit, found = [False] * len(w), set()
    for item, t in items:
        v = brute_words(t)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    found.add(str(item))
                    hit[p : p + n] = [True] * n
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Short ONE"), (10, "b c d e f g h i j k"), (3, None), (4, " .. "), (2, "short one"), (5, "élan É x")]
DOCS = [
    (1, "x A b, c d e f g h i j k l y"),
    (2, None),
    (3, ""),
    (4, "short one short one"),
    (4, "short one short one"),
    (5, "b c d e f g h i j"),
    (6, "b c d e f g h i j k" * 3),
    (None, "ÉLAN élan É X élan é x"),
    (7, "a b c d e f g h i j " * 4000),
    (8, "b c d e f g h i j\x00k"),
]


def test_small_cases_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in DOCS], "doc_id long, text string, n_words string, item_id string, n_chars int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in d.contamination(docs, bench).collect()), key=str)
    want = sorted(((i, *brute(t if i != 7 else "a b c d e f g h i j " * 40, ITEMS)) for i, t in DOCS), key=str)
    big = {r[0]: r for r in got}[7]
    assert big[1] == 40000 and big[2] == 40000
    assert [r for r in got if r[0] != 7] == [r for r in want if r[0] != 7]


def test_blocks_give_the_same_rows(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    names = ("n", "spans", "matches")
    one = d.annotate(docs.select("doc_id", "text"), bench, names).drop("text")
    many = d.annotate(docs.select("doc_id", "text"), bench, names, block_bytes=2000).drop("text")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_driver_tables_against_brute_force(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r[0], r[1]) for r in bench.collect()]
    got = {r[0]: tuple(r)[1:6] for r in d.contamination(docs, bench).collect()}
    short = [r for r in docs.collect() if len(r["text"]) < 3000][:60]
    for r in short:
        assert got[r["doc_id"]] == brute(r["text"], items)
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, v in got.items() if not v[4]}


def test_empty_tables(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert d.contamination(docs.where("false"), bench).count() == 0
    none = d.contamination(docs, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.where("longest_match > 0 or longest_item is not null").count() == 0


def brute_longest(text, items, window=10):
    """(words, item, place, item place) of the longest match; the first one of several."""
    w, best = brute_words(text), None
    for item, t in items:
        v = brute_words(t)
        least = min(window, len(v))
        for p in range(len(w)):
            for i in range(len(v)):
                n = 0
                while p + n < len(w) and i + n < len(v) and w[p + n] == v[i + n]:
                    n += 1
                if n >= least > 0:
                    key = (-n, p, str(item), i)
                    best = key if best is None else min(best, key)
    return (0, None, None, None) if best is None else (-best[0], best[2], best[1], best[3])


def test_longest_matches_against_brute_force(spark, small):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(40))) for k in range(12)] + [(90, "same same " * 12), (91, "tiny one"), (90, "w1 w2 w3")]
    docs = [(-1, "same " * 30), (-2, "tiny one and tiny one"), (-3, None)]
    for i in range(120):
        parts = [rnd.choice(vocab) for _ in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(3)):
            v = brute_words(rnd.choice(items)[1])
            a = rnd.randrange(len(v))
            parts += v[a : a + rnd.randrange(1, 35)] + [rnd.choice(vocab)]
        docs.append((i, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["longest_match"], r["longest_item"], r["longest_place"], r["longest_item_place"]) for r in d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {i: brute_longest(t, items) for i, t in docs}
    assert sum(m[0] > 12 for m in got.values()) > 20


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 5, None, "b" * 9, "c"])], ["i", "t"])
    assert [s.num_rows for s in byte_slices(batch, 1, 6)] == [2, 1, 1] and [s.num_rows for s in byte_slices(batch.slice(0, 0), 1)] == [0]


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a", 1, "x"), (2, "a b c d e f g h i j k", 2, "y")], "doc_id long, text string, found_words int, Found_Spans string")
    kept = d.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a", 1, "x")]
