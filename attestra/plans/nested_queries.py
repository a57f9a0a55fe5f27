"""Nested redaction and decomposed words over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from .registry import query


@query("str16_nested_redaction", """
SELECT event_id, '{"a":' || replace(props, ' ', '') || ',"Token":"[redacted]","list":[{"b":{"secret":"[redacted]","keep":[' || event_id || ',{"password":"[redacted]"}]}},"token"]}' AS json FROM events""")
def _(t):
    nested = F.concat(F.lit('{"a": '), "props", F.lit(', "Token": {"x": [1, {"y": "}"}]}, "list": [ {"b": {"secret": "'), "event_type", F.lit('", "keep": ['), F.col("event_id").cast("string"), F.lit(', {"pass\\u0077ord" : null}]}}, "token"]}'))
    return t.events.select("event_id", F.replace(N.redacted_json(nested), F.lit("pass\\u0077ord"), F.lit("password")).alias("json"))


@query("str11_decomposed_words", """
SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(list_concat(w, ['fin', 'iv', 'c', 'z', 'e', '1', '2', 'abc', 'strasse']), ' ')) AS words FROM (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[a-z0-9]+') AS w FROM documents)""")
def _(t):
    text = F.concat("text", F.lit(" ﬁn Ⅳ ć ż é ½ ＡＢＣ STRAẞE"))
    words = N.folded_words(text)
    return t.documents.select("doc_id", words.alias("w")).select("doc_id", (F.size("w") - 9).alias("n_words"), F.md5(F.array_join("w", " ")).alias("words"))
