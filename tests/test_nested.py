"""Redaction of nested JSON and decomposition of words, against plain Python."""

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from attestra.functions import nested as N
from attestra.functions.text import SECRET_KEYS


def redact(x):
    if isinstance(x, dict):
        return {k: "[redacted]" if k.lower() in SECRET_KEYS else redact(v) for k, v in x.items()}
    return [redact(v) for v in x] if isinstance(x, list) else x


def made(rng, depth=0):
    kind = rng.randrange(6 if depth < 5 else 3)
    if kind == 0:
        return rng.choice([None, True, 1.5, -3, 10**9])
    if kind in (1, 2):
        return rng.choice(["", "token", 'a "quoted" {x: [', "\\", "é\n\t", "}", "a:b,c"])
    if kind == 3:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b c", "Token", "API_KEY", "password", "secretly", 'q"', "x-api-key", "e\\"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_redaction_at_any_depth(spark):
    rng = random.Random(1)
    rows = [(k, made(rng)) for k in range(300)]
    deep = {"token": 1}
    for _ in range(60):
        deep = {"k": [deep, {"secret": {"a": [1, {"b": 2}]}}]}
    rows.append((300, deep))
    frame = spark.createDataFrame([(k, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for k, v in rows] + [(901, None), (902, "{not json"), (903, '"token"'), (904, r'{"password": [1, {"x": 2}], "n": 1}')], "k int, j string")
    got = {r.k: r.j for r in frame.select("k", N.redacted_json(F.col("j")).alias("j")).collect()}
    for k, v in rows:
        assert json.loads(got[k]) == redact(v), v
    assert got[901] is None and got[902] is None and got[903] == '"token"' and json.loads(got[904]) == {"password": "[redacted]", "n": 1}
    plan = frame.select(N.redacted_json(F.col("j")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def words(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return re.findall("[a-z0-9]+", plain.casefold())


def test_folded_words(spark):
    rng = random.Random(2)
    pool = [c for c in map(chr, range(32, 0x2200)) if unicodedata.category(c) != "Cn"] + list("ﬁﬀＡｂ１㎏①🄰𝐀𝟗ẞß")
    texts = ["", "ﬁn Ⅳ ć é", "STRAẞE ½ x́y", "éa", *["".join(rng.choice(pool) for _ in range(60)) for _ in range(120)]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(999, None)], "k int, t string")
    got = {r.k: r.w for r in frame.select("k", N.folded_words(F.col("t")).alias("w")).collect()}
    assert got[999] is None
    for k, t in enumerate(texts):
        assert got[k] == words(t), t
