import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from attestra.llm import spelling_variants as v


def brute_counts(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_groups(n):
    """By all edits of each word."""
    letters = sorted({c for w in n for c in w})
    near = defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            for c in ["", *letters]:
                for x in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
                    if x != w and x in n:
                        near[w].add(x)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_groups(brute_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert len(want) > 500 and any(r[1] for r in want) and rows_of(v.variants(docs)) == want


def test_dense_vocabulary_and_chains(spark):
    rng = random.Random(5)
    n = {}
    for _ in range(1_500):
        w = "".join(rng.choice("abé") for _ in range(rng.choice((7, 8, 9))))
        n[w] = rng.choice((2, 3, 25, 40, 300, 4000, 70_000))
    for k, w in enumerate(("zzzzzzz", "zzzzzzzz", "zzzzzzzzz", "zzzzzzzzzz", "yzzzzzzzzzz")):  # runs of one letter, and a chain
        n[w] = 2 * 10**k
    got = rows_of(v.group_variants(spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(3)))
    assert got == brute_groups(n)


def test_collisions_are_told_apart(spark, monkeypatch):
    """With a hash of three values alone the result is the same."""
    words = ["abcdefg", "abcdefh", "abcdefgh", "xbcdefg", "qrstuvw", "qrstuvx", "mnopqrs"]
    n = {w: 2 + 30 * k for k, w in enumerate(words)}
    frame = spark.createDataFrame([(k, w, n[w]) for k, w in enumerate(words)], "wid bigint, word string, n bigint")
    keys = v.keys_of(frame).selectExpr("pmod(key, 3) AS key", "at", "wid", "first")
    monkeypatch.setattr(v, "keys_of", lambda _: keys)
    got = {r.wid: (r.n_near, r.best.word) for r in v.near_words(frame).collect()}
    want = {w: (k, f) for w, f, _, _, k, _ in brute_groups(n)}
    assert {words[k]: x[0] for k, x in got.items()} == {w: k for w, (k, _) in want.items() if k}


def test_keys_are_those_of_the_texts():
    def key(word):
        return v.deletion_keys(np.array([[ord(c) for c in word]], np.uint64))[0, -1]

    for word in ("abcdefgé", "zzzzzzz", "aXbXcXdX"):
        keys = v.deletion_keys(np.array([[ord(c) for c in word]], np.uint64))[0]
        assert [keys[i] for i in range(len(word))] == [key(word[:i] + word[i + 1 :]) for i in range(len(word))]


def test_odd_rows(spark):
    long = "pneumonoultra" * 800
    rows = [(1, None, "x"), (2, "", "x"), (None, "Wordings wordings WORDINGS", "x"), (3, long + " " + long[:-1] + "x", "x"), (3, long + " " + long[:-1] + "x", "x"), (4, "ÀÉÎÕÜß× ÀÉÎÕÜß×", "x"), (5, "a" * 30_000 + " " + "a" * 30_000, "x")]
    got = rows_of(v.variants(spark.createDataFrame(rows, "doc_id bigint, text string, word string")))
    n = brute_counts([(r[0], r[1]) for r in rows])
    assert [(r[0], r[3]) for r in got] == sorted(n.items())
    # among the two long words, if both are whole, one character is another
    assert all(r[4] == (1 if len(r[0]) == len(long) and sum(len(w) == len(long) for w in n) == 2 else 0) for r in got if r[0][:3] == "pne")
    assert v.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("run,doc", [("example", str(i)) for i in range(40)])
def test_one_in_31_loses_a_character(run, doc):
    h = zlib.crc32(f"{doc}:{run}".encode())
    assert v.observed(run, doc) == (run if h % 31 else run[: h % 7] + run[h % 7 + 1 :])
