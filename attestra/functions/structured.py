"""Hashes, canonical JSON and nested values."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Versions that enter identities.
RULES_VERSION = "1.0.0"
CONTRACT_VERSION = "1.0.0"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(rule_id: Column, subject: Column, version: str = RULES_VERSION) -> Column:
    return F.sha2(F.concat_ws("|", rule_id, F.lit(version), subject), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON text of an object with sorted keys and no spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def dedup_key(document_id: Column, field_path: Column, locator: Column, method: Column) -> Column:
    return F.sha2(canonical_json(document_id=document_id, field_path=field_path, locator=locator, method=method), 256)


def storage_key(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def outermost_object(text: str | None) -> str | None:
    """The last JSON object of noisy text that no other object holds."""
    if not text:
        return None
    read, found, at = json.JSONDecoder().raw_decode, None, text.find("{")
    while at >= 0:
        try:
            _, end = read(text, at)
            found = text[at:end]
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return found


def _outermost(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([outermost_object(t) for t in texts], dtype=object)


def last_json(c: Column, schema: str) -> Column:
    """The last JSON object inside noisy text, nested ones included.  Balanced
    braces are beyond regular expressions, so Python looks for it in batches."""
    return F.from_json(F.pandas_udf(_outermost, "string")(c), schema)


def detail_rows(c: Column, labels: Mapping[str, str]) -> Column:
    """Entries of a map as sorted (label, value) structs."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(F.coalesce(F.try_element_at(pairs, e["key"]), e["key"]).alias("label"), e["value"].alias("value")))


def _find(node, wanted: str):
    if isinstance(node, dict):
        for v in node.values():
            if v == wanted:
                return node
        children = node.values()
    elif isinstance(node, list):
        children = node
    else:
        return None
    for child in children:
        found = _find(child, wanted)
        if found is not None:
            return found
    return None


def _objects(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for documents, wanted in batches:
        out = []
        for text, value in zip(documents, wanted, strict=True):
            try:
                found = _find(json.loads(text), value) if text is not None else None
            except ValueError:
                found = None
            out.append(None if found is None else json.dumps(found, sort_keys=True, ensure_ascii=False))
        yield pd.Series(out, dtype=object)


def object_with_value(document: Column, wanted: Column) -> Column:
    """The first object, depth first, that has the value (as JSON text)."""
    return F.pandas_udf(_objects, "string")(document, wanted)
