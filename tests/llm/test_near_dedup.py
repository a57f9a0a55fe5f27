import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import near_dedup as nd
from attestra.llm.components import components
from attestra.llm.decontaminate import words


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    least = sum((a & b).values())
    most = sum((a | b).values())
    return least / most if most else 0.0


def brute(rows):
    first, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        if i is not None:
            parent.setdefault(i, i)
            first[t or ""] = min(first.get(t or "", i), i)
    reps = sorted({v: k for k, v in first.items()}.items())
    sets = [(i, shingles(t)) for i, t in reps]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if jaccard(a, b) >= 0.8:
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [(i, None if i is None else find(first[t or ""])) for i, t in rows]


def test_signatures_estimate_weighted_jaccard():
    rnd = random.Random(5)
    texts, truth = [], []
    for k in range(300):
        vocab = [f"w{k}x{j}" for j in range(50)]
        base = [rnd.choice(vocab) for _ in range(60)]
        a = " ".join(base[:40] * 3 + [rnd.choice(vocab) for _ in range(30)])
        b = " ".join(base[:40] * 2 + [rnd.choice(vocab) for _ in range(30)])
        texts += [a, b]
        truth.append(jaccard(shingles(a), shingles(b)))
    sig, _ = nd.signatures(texts)
    got = (sig[::2] == sig[1::2]).mean()
    assert abs(got - np.mean(truth)) < 0.01


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and got[200] == got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cases():
    rnd = random.Random(9)
    vocab = [f"word{k}" for k in range(2000)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(120)]
        for c in range(7):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((g * 100 + c, " ".join(w)))
        rows.append((g * 100 + 50, " ".join(base)))
        rows.append((g * 100 + 51, " ".join(base)))
    return rows + [(5000, None), (5001, ""), (5002, "a b"), (5003, "A, b!"), (5004, "..."), (None, "a b"), (5002, "a b"), (5005, "x y z " * 20000), (5006, "x y z " * 19000)]


def test_classes_against_brute_force(spark, small):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int")
    got = sorted(map(str, (tuple(r) for r in nd.classes(docs).collect())))
    assert got == sorted(map(str, brute(rows)))
    kept = nd.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in brute(rows) if i is not None}) and ids.count(None) == 1
    assert nd.classes(docs.where("false")).count() == 0


def test_driver_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in nd.classes(docs).collect()) == sorted(brute(rows))


def test_a_family_of_texts_that_are_too_different(spark):
    """Hundreds of texts of similarity 0.6 to 0.75 share passages, but few are near copies."""
    rnd = random.Random(4)
    vocab = [f"word{k}" for k in range(3000)]
    base = [rnd.choice(vocab) for _ in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        at = rnd.randrange(80)
        w[at : at + 14] = [rnd.choice(vocab) for _ in range(14)]
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*w, "tail"])))
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def family(n, changed):
    """Texts of 400 words, so many of them changed in each, at random places."""
    rnd = random.Random(1)
    vocab = [f"word{k}" for k in range(20000)]
    base = [rnd.choice(vocab) for _ in range(400)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rnd.sample(range(400), changed):
            w[at] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("changed", [5, 6])
def test_a_family_around_the_similarity_is_not_compared_in_pairs(spark, monkeypatch, changed):
    """Similarities just under and over 0.8: classes as by brute force, and pairs
    that grow with the texts, not with their square."""
    sent, verify = [], nd.verified

    def counted(pairs, texts):
        sent.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(nd, "verified", counted)
    compared = []
    for n in (100, 200):
        rows = family(n, changed)
        sent.clear()
        got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute(rows))
        compared.append(sum(sent))
    assert compared[1] <= 2.6 * compared[0] and compared[1] < 200 * 199 / 2 / 5


def test_bit_fields_never_hide_a_pair(spark, monkeypatch):
    """The bound by changes alone decides, without rounds: still all classes."""
    monkeypatch.setattr(nd, "ROUND_PAIRS", 0)
    rnd = random.Random(8)
    vocab = [f"word{k}" for k in range(300)]
    rows = []
    for g in range(4):
        base = [rnd.choice(vocab) for _ in range(150)] * (1 + g % 2)
        for c in range(25):
            w = list(base)
            for at in rnd.sample(range(len(w)), rnd.randint(1, 5)):
                w[at : at + 1] = [rnd.choice(vocab) for _ in range(rnd.randint(0, 3))]
            rows.append((g * 100 + c, " ".join(w)))
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_different_texts_under_one_id_and_clashing_columns(spark):
    rnd = random.Random(6)
    vocab = [f"word{k}" for k in range(3000)]
    a, b = (" ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(2))
    rows = [(1, a, 5, "x"), (1, b, 6, "y"), (2, a + " tail", 7, None), (3, b + " tail", 8, "z"), (1, a, 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_nth int, KEPT_ID string")
    got = {tuple(r) for r in nd.one_per_class(docs).collect()}
    assert {r[:2] for r in got} == {(1, a), (1, b)} and len(got) == 2
    assert nd.one_per_class(docs).columns == docs.columns
    assert sorted(tuple(r) for r in nd.classes(docs).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_recall_by_similarity(spark):
    """Planted pairs of similarity 0.8 and more are all found."""
    rnd = random.Random(12)
    vocab = [f"word{k}" for k in range(5000)]
    rows = []
    for i in range(400):
        w = [rnd.choice(vocab) for _ in range(100)]
        rows.append((2 * i, " ".join(w)))
        at = rnd.randrange(70)
        w[at : at + rnd.randint(1, 9)] = [rnd.choice(vocab)]
        rows.append((2 * i + 1, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    near = [i for i in range(400) if jaccard(sets[2 * i], sets[2 * i + 1]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 200 and all(got[2 * i + 1] == 2 * i for i in near)
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) == len(near)


def test_shingles_that_no_other_text_has_are_not_sent(spark):
    """Millions of different shingles, of which no two texts share one but two."""
    words_of = F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 10000 + i).cast("string")))
    texts = spark.range(0, 700, 1, 8).select(F.col("id").alias("node"), F.array_join(words_of, " ").alias("text"))
    assert nd.prefix_rows(texts).count() == 0
    base = " ".join(f"x{k}" for k in range(19))
    pair = spark.createDataFrame([(1000, base + " y"), (1001, base + " z")], "node long, text string")
    got = sorted((r.node, r.place >> 32, r.place & 0xFFFFFFFF) for r in nd.prefix_rows(texts.union(pair)).collect())
    assert got == [(node, 16, place) for node in (1000, 1001) for place in (1, 2, 3)]
