import hashlib
import random

import pytest

from attestra.llm import sentencepiece_codec as sc
from attestra.llm.queries import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pair():
    path = tokenizer_path("piece_bpe_32k.model")
    return sc.Codec.of(path), sentencepiece.SentencePieceProcessor(model_file=path), path


def test_random_texts_equal_the_library(pair):
    codec, lib, _ = pair
    rnd, pieces = random.Random(3), list(codec.piece_id)
    letters = "ab the ing  \n\t▁é漢字😀\u0000<s>0x.,-==__aaaa//  "
    for k in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) if k % 2 else "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))
        ids = lib.encode(text, add_eos=True)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == lib.decode(ids)


def test_documents(spark, pair, small):
    codec, lib, path = pair
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r[0], r[1]) for r in docs] + [(None, None), (-1, ""), (-2, "x" * 50_000), (-3, " " * 3000 + "\n"), (-2, "twice")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(str, (tuple(r) for r in sc.token_digests(frame, path).collect())))
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(map(str, want))
    assert sc.token_digests(frame.where("false"), path).count() == 0
    first = sc.encode_ids(frame.where("doc_id = -1"), path).first()
    assert first["ids"] == [2] and first["decoded"] == ""
