import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestra.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTE = byte_of()


def tokens(libraries, text):
    """(ids, bytes) of both sides by the libraries, or nothing."""
    if not text:
        return None
    t, s = libraries
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    spelled_a = [bytes(BYTE[c] for c in t.id_to_token(i)) for i in a]
    pieces = [s.id_to_piece(i) for i in b]
    spelled_b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    whole = (" " + text).encode()
    return (list(zip(a, spelled_a)), list(zip(b, spelled_b))) if b"".join(spelled_a) == whole == b"".join(spelled_b) else None


def brute(libraries, rows):
    made, holders = [], Counter()
    for doc_id, text in rows:
        both = tokens(libraries, text)
        groups = []
        if both:
            ends = []
            for side in both:
                at, own = 0, []
                for i, t in side:
                    at += len(t)
                    own.append((at, i))
                ends.append(own)
            cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
            start = 0
            for c in cuts:
                groups.append(tuple([i for e, i in own if start < e <= c] for own in ends))
                start = c
        links = Counter()
        for x, y in groups:
            for i in x:
                for j in y:
                    links[i, j] += 1
        holders.update(links.keys())
        made.append((doc_id, groups, links))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def texts():
    rng = random.Random(3)
    words = ["wording", "éàü", "naïve", "日本語", "🙂", "x" * 70, "don't", "12345", "  ", "\n", "\t ", "===", "a_b", "<|endoftext|>", "</s>", "ÀÉ", "Привет", " ", " "]
    out = [None, "", " ", "\n", "a▁b", "a" * 3000 + " b", " " * 500, "\x00\x01", "é" * 400, "x̀y", "1" * 999]
    out += ["".join(rng.choice(words) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return out


@pytest.mark.parametrize("small_cuts", [False, True])
def test_against_brute_force(spark, small, libraries, monkeypatch, small_cuts):
    """With tiny runs, cuts and parts too, so that each document is cut many times."""
    if small_cuts:
        monkeypatch.setattr(al, "RUN_EVENTS", 7)
        monkeypatch.setattr(al, "CUT_TOKENS", 11)
        monkeypatch.setattr(al, "PART_PAIRS", 50)
        monkeypatch.setattr(al, "KEEP_WORDS", 5)
        monkeypatch.setattr(al, "LINKS_AT_ONCE", 2)
    docs = texts()
    docs += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(40 if small_cuts else 80).collect()]
    rows = [(k, t) for k, t in enumerate(docs)] + [(5, docs[5]), (None, docs[20]), (None, None), (20, docs[20])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, row int, pair string").repartition(3)
    tokenizers = al.Tokenizers(spark, A, B)
    assert result(al.alignment_digests(frame, tokenizers)) == brute(libraries, rows)


def test_groups(spark, libraries):
    rows = [(k, t) for k, t in enumerate(texts())]
    got = defaultdict(list)
    for r in al.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), al.Tokenizers(spark, A, B)).collect():
        got[r.doc_id].append(r)
    for k, text in rows:
        both = tokens(libraries, text)
        own = sorted(got.pop(k, []), key=lambda r: r.start)
        if not both:
            assert not own
            continue
        for side, name in zip(both, ("a_ids", "b_ids"), strict=True):
            assert [i for r in own for i in r[name]] == [i for i, _ in side]
        spelled = [{i: t for i, t in side} for side in both]
        whole = (" " + text).encode()
        assert all(b"".join(spelled[x][i] for i in r[n]) == whole[r.start : r.end] for r in own for x, n in enumerate(("a_ids", "b_ids")))
    assert not got


def test_empty_table(spark):
    assert al.alignment_digests(spark.createDataFrame([], "doc_id bigint, text string"), al.Tokenizers(spark, A, B)).count() == 0


@pytest.fixture(scope="module")
def sides():
    return al.ByteLevel(A), al.Pieces(B)


def test_words_give_what_the_libraries_give(sides, libraries):
    @settings(max_examples=400, deadline=None)
    @given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab 's'\n\t\x1c\x1f\x85\xa0  '12é²½·ªß")), max_size=40))
    def holds(text):
        want = tokens(libraries, text)
        got = [side.packed([text])[0] for side in sides]
        if not text:
            return
        for side, packed, ids in zip(sides, got, want or (None, None), strict=True):
            if ids is not None:
                assert np.frombuffer(packed, side.words.dtype).tolist() == [i for i, _ in ids]
        assert want is not None or None in got

    holds()
