"""Captured web pages: which urls may be fetched, and fields by selector."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Selectors of the call page, and whether each is required.
CALL_SELECTORS = {
    "call.code": ('[data-field="call-code"]', True),
    "call.eligible_from": ('[data-field="eligible-from"]', True),
    "call.eligible_to": ('[data-field="eligible-to"]', True),
    "call.max_funding_eur": ('[data-field="max-funding"]', True),
    "call.status": ('[data-field="status"]', False),
}


def url_verdict(url: Column, hosts: Sequence[str]) -> Column:
    """Why a url may not be fetched; null if it may."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    return F.when(~scheme.isin("http", "https"), "scheme").when(F.contains(authority, F.lit("@")), "credentials").when(~host.isin(*hosts), "host")


def public_address(address: str) -> bool:
    """Whether an address may be connected to."""
    a = ipaddress.ip_address(address)
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified)


class _Select(HTMLParser):
    """Text of the first element for each simple selector: tag, #id, .class or
    [attribute="value"]."""

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, selectors: Sequence[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = {s: self.split(s) for s in selectors}
        self.found: dict[str, str] = {}
        self.open: list[tuple[str, list[str], list[str]]] = []

    @staticmethod
    def split(selector: str) -> tuple[str, str]:
        if selector.startswith("["):
            name, _, value = selector[1:-1].partition("=")
            return name, value.strip("\"'")
        return {"#": ("id", selector[1:]), ".": ("class", selector[1:])}.get(selector[0], ("", selector))

    def matches(self, tag: str, attrs: dict[str, str | None], key: str, value: str) -> bool:
        if not key:
            return tag == value
        have = attrs.get(key)
        return have is not None and (value in have.split() if key == "class" else have == value)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        hits = [s for s, (k, v) in self.wanted.items() if s not in self.found and self.matches(tag, known, k, v)]
        if tag not in self.void:
            self.open.append((tag, hits, []))
            for s in hits:
                self.found[s] = ""

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, hits, parts = self.open.pop()
            body = "".join(parts)
            for s in hits:
                self.found[s] = " ".join(body.split())
            if self.open:
                self.open[-1][2].append(body)
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1][2].append(data)


def select_text(html: str | None, selectors: Sequence[str], references: bool = True) -> list[str | None]:
    """Texts of the selectors; without ``references``, character references
    stay as they are written."""
    parser = _Select(selectors)
    parser.feed((html or "") if references else (html or "").replace("&", "&amp;"))
    parser.close()
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    return [parser.found.get(s) for s in selectors]


def page_fields(pages: DataFrame, id_col: str, html_col: str, selectors: Mapping[str, tuple[str, bool]] = CALL_SELECTORS, references: bool = True) -> DataFrame:
    """(id, field_path, value, missing): a row for each selector; ``missing``
    marks a required one that isn't there, a change of the page's structure.
    Character references are resolved, or (without ``references``) left to the
    caller as they are written."""
    paths = list(selectors)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [v for h in b.column(1).to_pylist() for v in select_text(h, [selectors[p][0] for p in paths], references)]
            ids = b.column(0).take(pa.array([i for i in range(b.num_rows) for _ in paths]))
            missing = [v is None and selectors[p][1] for v, p in zip(values, paths * b.num_rows, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(paths * b.num_rows), pa.array(values, pa.string()), pa.array(missing)], ["id", "field_path", "value", "missing"])

    return pages.select(id_col, html_col).mapInArrow(run, f"id {kind}, field_path string, value string, missing boolean").withColumnRenamed("id", id_col)
