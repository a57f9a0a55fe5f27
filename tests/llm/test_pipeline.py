import hashlib

import sentencepiece

import corpus_pipeline
from attestra.llm.queries import tokenizer_path
from attestra.llm.toxicity import train

from . import naive
from .test_decontaminate import brute as brute_leaks
from .test_near_dedup import brute as brute_classes


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, bench = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    model = train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(r["text"]) < 0.5]
    kept = [(i, "" if t is None else k) for (i, t), (_, k, _, _) in zip(rows, naive.without_lines(rows), strict=True)]
    texts = dict(kept)
    ids = [i for i, c in brute_classes(kept) if i == c]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    ids = [i for i in ids if len(texts[i]) > 20_000 or not brute_leaks(texts[i], items)[4]]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, small).collect()}
    long = {i for i in ids if len(texts[i]) > 20_000}
    assert set(got) - long == set(ids) - long and set(got) <= set(ids)
    for i in got:
        tokens = library.encode(texts[i], add_eos=True)
        assert got[i] == (len(tokens), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, tokens)), library.decode(tokens))))


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert len(corpus_pipeline.STAGES) == 5
