"""Media columns: documents as sequences of text and media references.

``sequence_of`` parses HTML into ordered structs: text runs and references to
media, each with its position and, for a figure, its caption.  References name
the digest of their payload; ``resolve`` joins them with the media store, so
that positions and captions stay with the reference whatever the join does.

The store keeps a payload losslessly as the samples of an 8-bit grey PNG image
(``STRIDE`` samples a line), one row for each document that brings it; readers
take each digest once.

Defined results: null text and null HTML count as empty; an empty text is
stored as one padded line; equal payloads share a digest and every value; repeated
rows give a row each; very long texts are stored whole; a null id stays null; an
empty table gives no rows; a reference whose digest is not in the store resolves
to nulls.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, pick, stored

STRIDE = 576
SCHEME = "media:"
ELEMENT = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
FEATURES = "digest string, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"


def padded(data: bytes, unit: int = STRIDE) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    lines = len(payload) // STRIDE
    raw = np.zeros((lines, STRIDE + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, STRIDE)
    head = struct.pack(">IIBBBBB", STRIDE, lines, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG whose lines are not filtered."""
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("8-bit grey samples are needed")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return raw[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Size, mean sample and a difference hash over eight by nine cells."""
    cells = np.add.reduceat(samples.sum(0, dtype=np.int64), np.linspace(0, samples.shape[1], 65, dtype=int)[:-1])
    bits = "".join("1" if a < b else "0" for a, b in zip(cells, np.roll(cells, -1), strict=True))
    return f"{samples.shape[1]}x{samples.shape[0]}:{int(samples.sum(dtype=np.int64)) * 1000 // samples.size}:{int(bits, 2):016x}"


class _Sequence(HTMLParser):
    """Collects text runs and media references in reading order."""

    media_tags = {"img", "video", "audio", "source", "embed"}
    silent = {"script", "style", "template", "noscript"}
    inline = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text: str | None = None, digest: str | None = None, caption: str | None = None) -> None:
        self.out.append({"position": len(self.out), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.silent:
            self.hidden += 1
        if tag in self.inline:
            return
        self.flush() if self.caption is None else None
        known = dict(attrs)
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.media_tags and known.get("src"):
            src = known["src"]
            self.add(tag, text=None if src.startswith(SCHEME) else src, digest=src[len(SCHEME) :] if src.startswith(SCHEME) else None, caption=known.get("alt") or None)
            if self.figure is not None:
                self.figure.append(len(self.out) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent and self.hidden:
            self.hidden -= 1
        if tag in self.inline:
            return
        if tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.out[i]["caption"] = caption or self.out[i]["caption"]
            self.caption = None
        elif self.caption is None:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, sequence): the ordered elements of each page."""
    arrow_rows(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    element = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence_of(h) for h in b.column(1).to_pylist()], element)], ["id", "sequence"])

    return pick(pages, id_col, html_col).mapInArrow(run, f"id {kind}, sequence array<{ELEMENT}>").withColumnRenamed("id", id_col)


def resolve(seqs: DataFrame, id_col: str, features: DataFrame) -> DataFrame:
    """One row for each media reference, with what the store has of it."""
    refs = seqs.select(id_col, F.explode("sequence").alias("e")).where("e.kind != 'text'").select(id_col, "e.position", "e.caption", "e.digest")
    return refs.join(features, "digest", "left")


def store_texts(docs: DataFrame) -> DataFrame:
    """Write each text as a media payload, and an HTML page that refers to it."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, sizes, digests, media = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                pages.append(f'<article><h1>{escape(str(i))}</h1><figure><img src="{SCHEME}{digest}"><figcaption>{len(data)} bytes</figcaption></figure></article>')
                sizes.append(len(data))
                digests.append(digest)
                media.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "html", "digest", "media"])

    return stored(pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, html string, digest string, media binary"), "media")


def store_features(store: DataFrame) -> DataFrame:
    """Read the stored bytes back; one row for each digest."""
    arrow_rows(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seen = [], set()
            for digest, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                media = media.as_py()
                samples = from_png(media)
                payload = samples.tobytes()
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"stored payload differs from its digest {digest}")
                rows.append((digest, len(media), hashlib.sha256(media).hexdigest(), len(payload), sha, zlib.crc32(payload[-32:]), feature_of(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [f.split()[0] for f in FEATURES.split(", ")][1:]
    return pick(store, "digest", "media").mapInArrow(run, FEATURES).groupBy("digest").agg(F.min(F.struct(*names)).alias("f")).select("digest", "f.*")


def media_features(docs: DataFrame) -> DataFrame:
    """Per document the digests and features of its text stored as media."""
    kept = store_texts(docs)
    found = resolve(sequences(kept.select("doc_id", "html"), "doc_id", "html"), "doc_id", store_features(kept))
    # the caption travels with the reference and states the size before padding
    size = F.regexp_extract("caption", "^[0-9]+", 0).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("position").cast("int").alias("position"))
