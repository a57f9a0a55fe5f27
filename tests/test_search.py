"""Cover density against a sweep over all stretches; Spanish stems against published ones."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.functions.spanish import regions, stem
from attestra.operators import cover as C
from attestra.operators import retrieval as Q


def brute(words, terms):
    """Score of a text: all stretches that hold the terms it has, without another inside."""
    own = {t for t in terms if t in words}
    if not own:
        return None
    spans = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if own <= set(words[a : b + 1])]
    least = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    score = sum(1 / (1 + sum(w not in own for w in words[a : b + 1])) for a, b in least)
    return len(own), len(least), round(score, 6)


@pytest.mark.parametrize("terms", [("a", "b"), ("a",), ("a", "b", "c"), ("a", "q")])
def test_covers_against_all_stretches(spark, terms):
    rng = random.Random(7)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 25))] for _ in range(40)]
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "doc_id int, words array<string>")
    got = {r.doc_id: (r.covered, r.covers, r.score) for r in C.by_cover_density(C.positional_postings(frame, "doc_id", F.col("words")), "doc_id", terms, 50).collect()}
    want = {k: s for k, w in enumerate(texts) if (s := brute(w, terms))}
    if any(s[0] == len(terms) for s in want.values()):
        want = {k: s for k, s in want.items() if s[0] == len(terms)}
    assert got == want
    few = C.positional_postings(frame, "doc_id", F.col("words"), terms)
    assert {r.term for r in few.select("term").distinct().collect()} <= set(terms)


def test_order_of_the_ranking(spark):
    frame = spark.createDataFrame([(1, "a x x b".split()), (2, "a b".split()), (3, "a b".split()), (4, "a a a".split())], "doc_id int, words array<string>")
    got = C.by_cover_density(C.positional_postings(frame, "doc_id", F.col("words")), "doc_id", ["a", "b", "a"], 2).collect()
    assert [r.doc_id for r in got] == [2, 3]


# Words and stems of the algorithm's published sample.
SAMPLE = "cheque chequ chequeo cheque cheques chequ cheyre cheyr chiapas chiap chicago chicag chicas chic chico chic chicos chic chilena chilen chiquita chiquit chisme chism chispazo chispaz torá tor tórax torax torcer torc toreado tor toreándolo tor torear tor toros tor torpedearon torped torre torr torneo torne torturar tortur torturaron tortur".split()


@pytest.mark.parametrize("word,want", list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("word,want", [("haciéndolo", "hac"), ("nacionalidad", "nacional"), ("rápidamente", "rapid"), ("tecnología", "tecnolog"), ("ejecución", "ejecu"), ("existencia", "existent"), ("siguen", "sig"), ("a", "a"), ("", ""), ("yo", "yo")])
def test_each_step(word, want):
    assert stem(word) == want


def test_regions():
    assert regions("macho") == (3, 3, 5) and regions("oliva") == (3, 2, 4) and regions("trabajo") == (3, 4, 6) and regions("áureo") == (3, 3, 5)


def test_postings_stem_distinct_words_once(spark, monkeypatch):
    rows = [(1, ["Las", "Facturas", "facturas", "FACTURA"]), (2, ["factura", "la"]), (3, None), (4, [])]
    got = {tuple(r) for r in Q.spanish_postings(spark.createDataFrame(rows, "doc_id int, words array<string>"), "doc_id", "words").select("doc_id", "term", "tf").collect()}
    assert got == {(1, "factur", 3), (2, "factur", 1)}
