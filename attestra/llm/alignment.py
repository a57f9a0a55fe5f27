"""Alignment of two tokenizers' tokens by a sweep over their end events.

Each token ends at a byte of its text.  The ends of both tokenizers' tokens are
united, dealt by document and sorted by place within the partition; one pass
then cuts the tokens into *groups* wherever both end at one byte.  A *link* is a
token of the one and a token of the other in one group.

* An event row holds a run of successive ends of one tokenizer (``RUN_EVENTS`` at
  most, as ids, whose lengths give the places), so that runs are moved and sorted
  instead of single ends.
* ``Sweep`` is the state machine: it holds the runs that are not cut yet (a run of
  each side and what ``CUT_TOKENS`` allows), the open group, and sums.  Documents of any
  number and length stream through it.
* How many documents hold a pair of ids linked is counted over the whole corpus.
  Each part of the sweep asks for the pairs that it holds, once each; answers come
  back to the part, which walks through its documents again.  Pairs of documents
  are never sent one by one.

Groups are not expanded when both sides have many tokens: equal ids are counted
first, so that a text on which the two never meet costs its tokens and its distinct
pairs, not their product.

A document without tokens: its text is null or empty, or the bytes of either
tokenizer's tokens are not those of a space and the text (so with U+2581 in it).

Defined results: documents without tokens have zeros and ''; rows with null or
repeated ids keep a row each, and each counts as a document; an empty table gives
no rows; texts of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, byte_slices, pick, stored, take_worker, worker_tables
from .sentencepiece_codec import SPACE, Codec

#: Events in one row; tokens and documents that are cut together; pairs that one
#: part asks for; words that a worker keeps of each tokenizer, and their length;
#: new words that are encoded together, and bytes of text.
RUN_EVENTS, CUT_TOKENS, CUT_DOCS, PART_PAIRS = 1 << 16, 1 << 20, 30_000, 1 << 20
KEEP_WORDS, KEEP_LENGTH, ROW_WORDS, TEXT_BYTES = 200_000, 40, 2_000, 4 << 20
#: Groups of more links are counted by distinct ids.
LINKS_AT_ONCE = 64
#: Bits of the second id in a pair's key.
B_BITS = 24

_SPACES = "\\t-\\r \\x85\\xa0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f"
_WORKERS: dict[str, object] = {}


def _classes() -> tuple[str, str]:
    """Letters and numbers below U+0530, as the inside of a character class."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(0x530)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind].append(c)
    return "".join(kinds["L"]), "".join(kinds["N"])


class Words:
    """Packed ids of the words that a tokenizer looks at one by one; those used
    since the table was last full are kept.  ``whole`` encodes a text, ``one`` a word that
    can't stand in a row of words; ``led`` says which can."""

    def __init__(self, spelled: dict[int, bytes], dtype: str, whole: Callable[[str], list[int]], one: Callable[[str], list[int]], led: Callable[[str], bool]) -> None:
        self.spelled, self.dtype, self.whole, self.one, self.led = spelled, dtype, whole, one, led
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(max(spelled) + 1)], np.int64)
        self.new: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}

    def single(self, ids: list[int], text: str) -> bytes | bool:
        """Packed ids; False, if they don't spell the text."""
        return pack_ids(ids, self.dtype) if b"".join([self.spelled[i] for i in ids]) == text.encode() else False

    def learn(self, words: list[str]) -> dict[str, bytes | bool]:
        """Words that can are encoded in rows, and the rows are cut where they end."""
        led = [w for w in words if self.led(w)]
        found = {w: self.single(self.one(w), w) for w in set(words).difference(led)}
        for k in range(0, len(led), ROW_WORDS):
            row = led[k : k + ROW_WORDS]
            text = "".join(row)
            ids = self.whole(text)
            packed = self.single(ids, text)
            if packed is False:
                found.update((w, self.single(self.whole(w), w)) for w in row)
                continue
            wanted = np.cumsum([len(w.encode()) for w in row])
            stops = ((np.searchsorted(np.cumsum(self.lengths[ids]), wanted) + 1) * (len(packed) // len(ids))).tolist()
            found.update(zip(row, [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        return found

    def packed(self, texts: list[list[str] | None]) -> list[bytes | None]:
        """The ids of all words of each text; nothing, if one isn't spelled by its tokens."""
        if len(self.new) > KEEP_WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set().union(*[words for words in texts if words]).difference(new)
        again = missing.intersection(old)
        new.update({w: old[w] for w in again})
        new.update(self.learn(list(missing - again)))
        out: list[bytes | None] = []
        for words in texts:
            try:
                out.append(b"".join(map(new.get, words)) if words else None)
            except TypeError:  # a word that isn't spelled by its tokens
                out.append(None)
        for w in missing:
            if len(w) > KEEP_LENGTH:
                del new[w]
        return out

    def empty(self) -> None:
        self.new, self.old = {}, {}


class ByteLevel:
    """A byte-level BPE of a ``tokenizers`` file; its words are those of the published pattern."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        spelled, dtype = _byte_level(content)
        letters, numbers = _classes()
        either = letters + numbers
        self.plain = re.compile(r"[^\x00-\u052f\u2000-\u206f]")
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACES}{either}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
        spaces = re.compile(f"[{_SPACES}]")
        self.words = Words(spelled, dtype, self.encode, self.encode, lambda w: len(w) > 1 and w[0] == " " and not spaces.match(w, 1))

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def packed(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of a space and each text.  A text with characters whose class depends
        on the version of Unicode is left to the library whole."""
        odd = [t is not None and bool(self.plain.search(t)) for t in texts]
        made = self.words.packed([None if x or not t else self.cut.findall(" " + t) for t, x in zip(texts, odd, strict=True)])
        return [(self.words.single(self.encode(" " + t), " " + t) or None) if x else m for t, x, m in zip(texts, odd, made, strict=True)]


class Pieces:
    """A SentencePiece BPE; its words are what no piece crosses.  The library puts a
    space before what it encodes, so it takes rows of words that begin with one;
    the table of prefixes takes the others."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.codec, self.library = Codec(path), SentencePieceProcessor(model_file=path)
        spelled, dtype = _pieces(self.codec)
        self.cut = re.compile(self.codec.cut.pattern.replace(SPACE, " "))
        self.words = Words(spelled, dtype, lambda t: self.library.encode(t[1:], num_threads=1), self.one, lambda w: w[0] == " " and w[-1] != " ")

    def one(self, word: str) -> list[int]:
        return self.codec.ids(self.codec.tokens(word.replace(" ", SPACE)))

    def packed(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text; none, if it has the sign that stands for spaces."""
        return self.words.packed([self.cut.findall(" " + t) if t and SPACE not in t else None for t in texts])


def pack_ids(ids: list[int], dtype: str) -> bytes:
    made = array("H" if dtype == "<u2" else "I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _byte_level(content: str) -> tuple[dict[int, bytes], str]:
    """The bytes of each id of a byte-level vocabulary.  Bytes that aren't printable
    stand as the characters from 256 on, in order."""
    made = json.loads(content)
    steps = made["pre_tokenizer"]
    if made["model"]["type"] != "BPE" or made.get("normalizer") or steps["type"] != "ByteLevel" or steps["add_prefix_space"]:
        raise ValueError("a byte-level BPE without normaliser and prefix is needed")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in made["added_tokens"]}
    return {i: bytes([byte[c] for c in t]) for t, i in made["model"]["vocab"].items() if t not in special}, _dtype(len(made["model"]["vocab"]) + len(special))


def _pieces(codec: Codec) -> tuple[dict[int, bytes], str]:
    spelled = {i: t.encode() for i, t in codec.surface.items()} | {i: bytes([b]) for i, b in codec.decode_byte.items()}
    return spelled, _dtype(max(spelled) + 1)


class Tokenizers:
    """Two vocabulary files that Spark sends to its executors, and the lengths of their tokens."""

    def __init__(self, spark: SparkSession, byte_level: str, pieces: str) -> None:
        self.names = os.path.basename(byte_level), os.path.basename(pieces)
        for path in (byte_level, pieces):
            spark.sparkContext.addFile(path)
        with open(byte_level, encoding="utf-8") as f:
            both = _byte_level(f.read()), _pieces(Codec(pieces))
        self.dtypes = tuple(d for _, d in both)
        self.lengths = tuple(np.array([len(s.get(i, b"")) for i in range(max(s) + 1)], np.int32) for s, _ in both)

    def open(self) -> tuple[ByteLevel, Pieces]:
        """In a worker: both tokenizers."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for name, kind in zip(self.names, (ByteLevel, Pieces), strict=True):
            if name not in _WORKERS:
                _WORKERS[name] = kind(SparkFiles.get(name))
        return tuple(_WORKERS[n] for n in self.names)


def events(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """The end events of both tokenizers: (row, doc_id, side, start, ok, ids), a row for each run;
    ``row`` names the row of ``docs``.  Each row has a run of both sides, which may be empty."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("alignment")
        sides = tokenizers.open()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in (x for whole in batches for x in byte_slices(whole, 2, TEXT_BYTES)):
            texts = [t or None for t in b.column(2).to_pylist()]
            out: list[tuple] = []
            for side, of in enumerate(sides):
                for at, packed in enumerate(of.packed(texts)):
                    if packed is None:
                        out.append((at, side, 0, False, b""))
                        continue
                    ids = np.frombuffer(packed, tokenizers.dtypes[side])
                    start = 0
                    for k in range(0, len(ids), RUN_EVENTS):
                        part = ids[k : k + RUN_EVENTS]
                        out.append((at, side, start, True, squeeze(part.tobytes())))
                        if len(ids) > RUN_EVENTS:
                            start += int(tokenizers.lengths[side][part].sum())
            at, side, start, ok, ids = zip(*out) if out else ((),) * 5
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(side, pa.int8()), pa.array(start, pa.int64()), pa.array(ok, pa.bool_()), pa.array(ids, pa.binary())], ["row", "doc_id", "side", "start", "ok", "ids"])

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    return named.mapInArrow(run, f"row bigint, doc_id {kind}, side tinyint, start bigint, ok boolean, ids binary")


class Doc:
    """What is known of a document so far."""

    def __init__(self, row: int, doc_id: object, base: int) -> None:
        self.row, self.doc_id, self.base = row, doc_id, base
        self.ok, self.first = True, None
        self.n, self.size = [0, 0], [0, 0]
        self.groups = self.links = 0
        self.hash = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []


class Cut:
    """Groups in order: of which document (place among the open ones), their tokens' ids, how many of each side, ends."""

    def __init__(self, doc, a, b, n_a, n_b, end) -> None:
        self.doc, self.a, self.b, self.n_a, self.n_b, self.end = doc, a, b, n_a, n_b, end


class Sweep:
    """Takes runs in order of (row, start, side); cuts groups where both sides end."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.lengths, self.dtypes = tokenizers.lengths, tokenizers.dtypes
        self.ids: list[list[np.ndarray]] = [[], []]
        self.ends: list[list[np.ndarray]] = [[], []]
        self.docs: list[Doc] = []
        self.held = self.base = 0
        self.open = zstandard.ZstdDecompressor().decompress

    def take(self, row: int, doc_id: object, side: int, ok: bool, ids: bytes) -> None:
        doc = self.docs[-1] if self.docs else None
        if doc is None or doc.row != row:
            if doc:
                self.base = doc.base + doc.size[0]
            self.docs.append(Doc(row, doc_id, self.base))
            self.docs[-1].ok, self.docs[-1].first = ok, (side, ids)
            return
        if doc.first:  # both sides are known now
            doc.ok &= ok
            if doc.ok:
                self.add(doc, *doc.first)
            doc.first = None
        if doc.ok:
            self.add(doc, side, ids)

    def add(self, doc: Doc, side: int, ids: bytes) -> None:
        run = np.frombuffer(self.open(ids), self.dtypes[side])
        ends = np.cumsum(self.lengths[side][run], dtype=np.int64) + (doc.base + doc.size[side])
        self.ids[side].append(run)
        self.ends[side].append(ends)
        doc.n[side] += len(run)
        doc.size[side] = int(ends[-1]) - doc.base
        self.held += len(run)

    def full(self) -> bool:
        return self.held >= CUT_TOKENS or len(self.docs) >= CUT_DOCS

    def cut(self) -> Cut | None:
        """The groups that are closed; what follows the last of them stays."""
        (a, b), (ends_a, ends_b) = ([np.concatenate(x) if x else np.empty(0, np.int64) for x in both] for both in (self.ids, self.ends))
        if not len(a) or not len(b):
            return None
        at_b = np.searchsorted(ends_b, ends_a)
        met = ends_b[np.minimum(at_b, len(ends_b) - 1)] == ends_a
        last_a = np.flatnonzero(met)
        if not len(last_a):
            return None
        last_b = at_b[last_a]
        stop_a, stop_b = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        self.ids, self.ends = [[a[stop_a:]], [b[stop_b:]]], [[ends_a[stop_a:]], [ends_b[stop_b:]]]
        self.held = len(a) - stop_a + len(b) - stop_b
        end = ends_a[last_a]
        bases = np.array([d.base for d in self.docs], np.int64)
        doc = np.searchsorted(bases, end, "left") - 1  # a document ends after its base, which is the end of the one before
        # documents without tokens share their base with the next: the last of them is meant
        return Cut(doc, a[:stop_a], b[:stop_b], np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1), end)

    def done(self, final: bool) -> list[Doc]:
        """The documents that are over, after a cut; they are forgotten."""
        keep = 0 if final else 1
        out = self.docs[: len(self.docs) - keep]
        self.docs = self.docs[len(self.docs) - keep :]
        return out


def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of each id below ``size``, with a free place after them, and their number."""
    width = len(str(size - 1))
    digits = np.zeros((size, width + 1), np.uint8)
    number = np.ones(size, np.int64)
    for k in range(1, width):
        number[10**k :] += 1
    ids = np.arange(size)
    for k in range(width):
        rest = number - 1 - k
        digits[rest >= 0, k] = (ids // 10 ** np.maximum(rest, 0) % 10)[rest >= 0] + 48
    return digits, number


def spell(cut: Cut, table: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;``, and where each group ends in that text."""
    digits, number = table
    group_a, group_b = np.repeat(np.arange(len(cut.n_a)), cut.n_a), np.repeat(np.arange(len(cut.n_b)), cut.n_b)
    upto_a, upto_b = np.cumsum(cut.n_a), np.cumsum(cut.n_b)
    place_a = np.arange(len(cut.a)) + (upto_b - cut.n_b)[group_a]
    place_b = np.arange(len(cut.b)) + upto_a[group_b]
    ids = np.empty(len(cut.a) + len(cut.b), np.int64)
    ids[place_a], ids[place_b] = cut.a, cut.b
    after = np.full(len(ids), ord(","), np.uint8)
    after[upto_a + upto_b - cut.n_b - 1], after[upto_a + upto_b - 1] = ord("|"), ord(";")
    text, size = digits[ids], number[ids]
    text[np.arange(len(ids)), size] = after
    shown = np.arange(text.shape[1]) <= size[:, None]
    return text[shown].tobytes(), np.cumsum(size + 1)[upto_a + upto_b - 1]


def linked_pairs(cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair of ids, number of links), each document's pairs ascending and once."""
    links = cut.n_a * cut.n_b
    large = (links > LINKS_AT_ONCE) & (cut.n_a > 1) & (cut.n_b > 1)
    start_a, start_b = np.cumsum(cut.n_a) - cut.n_a, np.cumsum(cut.n_b) - cut.n_b
    of_a = np.repeat(np.arange(len(links)), cut.n_a)
    times = np.where(large, 0, cut.n_b)[of_a]
    token_a = np.repeat(np.arange(len(cut.a)), times)
    group = of_a[token_a]
    turn = np.arange(len(token_a)) - np.repeat(np.cumsum(times) - times, times)
    doc = [cut.doc[group]]
    pair = [(cut.a[token_a].astype(np.int64) << B_BITS) | cut.b[start_b[group] + turn]]
    n = [np.ones(len(token_a), np.int64)]
    for g in np.flatnonzero(large):
        ids_a, n_a = np.unique(cut.a[start_a[g] : start_a[g] + cut.n_a[g]], return_counts=True)
        ids_b, n_b = np.unique(cut.b[start_b[g] : start_b[g] + cut.n_b[g]], return_counts=True)
        pair.append(((ids_a.astype(np.int64) << B_BITS)[:, None] | ids_b.astype(np.int64)).ravel())
        n.append(np.outer(n_a, n_b).ravel())
        doc.append(np.full(len(pair[-1]), cut.doc[g]))
    return _summed(np.concatenate(doc), np.concatenate(pair), np.concatenate(n))


def _summed(doc: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = (doc.astype(np.int64) << 48) | pair
    found, at = np.unique(key, return_inverse=True)
    return found >> 48, found & ((1 << 48) - 1), np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def pack(pair: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs and numbers, as differences of the first ids, second ids and halves of the
    numbers, whose bytes stand apart: this compresses well."""
    low = (1 << 32) - 1
    columns = (np.diff(pair >> B_BITS, prepend=0) & low, pair & ((1 << B_BITS) - 1), n & low, n >> 32)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]))


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, 4, -1)
    a, b, low, high = (np.ascontiguousarray(c.T).view("<u4").ravel().astype(np.int64) for c in raw)
    return ((np.cumsum(a) & ((1 << 32) - 1)) << B_BITS) | b, low | (high << 32)


DOC = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def sorted_events(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """All events, each document's in one partition and in order."""
    return events(docs, tokenizers).repartition("row").sortWithinPartitions("row", "start", "side")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        row, doc_id, side, _, ok, ids = (c.to_pylist() for c in b.columns)
        yield from zip(row, doc_id, side, ok, ids, strict=True)


def swept(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Documents with their sums, many to a row: (part, seq, docs, lens, pairs, asked).  ``lens``
    tells how many pairs each has; ``pairs`` holds them, and ``asked`` all those of the part,
    with how many of its documents hold them, in its last row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part bigint, seq int, docs array<struct<{DOC.format(kind=kind)}>>, lens array<int>, pairs binary, asked binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, table = Sweep(tokenizers), _decimal(max(map(len, tokenizers.lengths)))
        part, seq, asked, doc_type = TaskContext.get().partitionId() << 20, 0, [], None

        def step(final: bool) -> tuple | None:
            cut = sweep.cut()
            if cut:
                text, stops = spell(cut, table)
                first = np.flatnonzero(np.append(True, cut.doc[1:] != cut.doc[:-1]))
                last = np.append(first[1:], len(cut.doc)) - 1
                links = np.add.reduceat(cut.n_a * cut.n_b, first)
                begin = 0
                for f, t, n in zip(first, last, links, strict=True):
                    doc = sweep.docs[cut.doc[f]]
                    doc.hash = doc.hash or hashlib.sha256()
                    doc.hash.update((b";" if doc.groups else b"") + text[begin : stops[t] - 1])
                    begin = stops[t]
                    doc.groups += int(t - f + 1)
                    doc.links += int(n)
                of, pair, n = linked_pairs(cut)
                edges = np.searchsorted(of, np.append(cut.doc[first], cut.doc[first[-1]] + 1))
                for k, d in enumerate(cut.doc[first]):
                    sweep.docs[d].pairs.append((pair[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]))
            done = sweep.done(final)
            if not done:
                return None
            each = []
            for d in done:
                if len(d.pairs) > 1:  # cut more than once
                    p, n = (np.concatenate(x) for x in zip(*d.pairs, strict=True))
                    d.pairs = [_summed(np.zeros(len(p), np.int64), p, n)[1:]]
                each.append(d.pairs[0] if d.pairs else (np.empty(0, np.int64), np.empty(0, np.int64)))
            pair, n = (np.concatenate(x) for x in zip(*each, strict=True))
            return done, [len(p) for p, _ in each], pair, n

        def ask(pair: np.ndarray | None) -> None:
            """Add pairs of whole documents, and sum when much is held, or at the end."""
            if pair is not None and len(pair):
                asked.append(np.unique(pair, return_counts=True))
            if len(asked) > 1 and (pair is None or sum(len(p) for p, _ in asked) > 2 * PART_PAIRS):
                p, n = (np.concatenate(x) for x in zip(*asked, strict=True))
                asked[:] = [_summed(np.zeros(len(p), np.int64), p, n)[1:]]

        def out(made: tuple | None, close: bool) -> pa.RecordBatch:
            nonlocal part, seq
            done, lens, pair, n = made or ([], [], np.empty(0, np.int64), np.empty(0, np.int64))
            rows = [{"doc_id": d.doc_id, "n_a": d.n[0] if d.ok else 0, "n_b": d.n[1] if d.ok else 0, "n_groups": d.groups, "n_links": d.links, "groups_sha256": d.hash.hexdigest() if d.hash else ""} for d in done]
            last = None
            if close:
                ask(None)
                if asked:
                    p, c = asked[0]
                    last = pack(p, c)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int32()), pa.array([rows], pa.list_(doc_type)), pa.array([lens], pa.list_(pa.int32())), pa.array([pack(pair, n)], pa.binary()), pa.array([last], pa.binary())],
                ["part", "seq", "docs", "lens", "pairs", "asked"],
            )
            seq += 1
            if close:
                part, seq = part + 1, 0
                asked.clear()
            return batch

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal doc_type
            for b in batches:
                doc_type = doc_type or pa.struct([("doc_id", b.schema.field("doc_id").type), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
                yield b

        row = None
        for r in _runs(typed(batches)):
            if r[0] != row and sweep.full():
                made = step(False)
                if made:
                    ask(made[2])
                    yield out(made, bool(asked) and len(asked[0][0]) > PART_PAIRS)
            elif sweep.held >= 4 * CUT_TOKENS:  # inside a long document
                made = step(False)
                if made:
                    ask(made[2])
                    yield out(made, False)
            row = r[0]
            sweep.take(*r)
        made = step(True)
        if made:
            ask(made[2])
        if made or asked:
            yield out(made, True)

    return sorted_events(docs, tokenizers).mapInArrow(run, schema)


def asked_pairs(parts: DataFrame) -> DataFrame:
    """(part, pair, n): what each part holds, and in how many of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pair, n = unpack(asked)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), part)), pa.array(pair), pa.array(n)], ["part", "pair", "n"])

    return pick(parts.where("asked IS NOT NULL"), "part", "asked").mapInArrow(run, "part bigint, pair bigint, n bigint")


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and whether no
    pair of its first id is in more."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", B_BITS))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def alignment_digests(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Per document its numbers of tokens, groups and links, how its links stand in the whole
    corpus, and a digest of its groups."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    parts = stored(swept(docs, tokenizers), "parts")
    asked = asked_pairs(parts)
    answers = asked.select("part", "pair").join(pair_counts(asked), "pair")
    arrow_rows(spark, 32_768)
    empty = {c: F.lit(None).cast(parts.schema[c].dataType) for c in ("docs", "lens", "pairs")}
    told = answers.select("part", F.lit(-1).alias("seq"), "pair", "count", "best", *[v.alias(c) for c, v in empty.items()])
    asks = parts.select("part", "seq", F.lit(None).cast("bigint").alias("pair"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("boolean").alias("best"), "docs", "lens", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known = None, [], None
        for b in batches:
            part, seq = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (seq[1:] != seq[:-1])))
            for begin, end in zip(edges, np.append(edges[1:], len(part)), strict=True):
                if part[begin] != at:
                    at, held, known = part[begin], [], None
                if seq[begin] < 0:
                    own = b.slice(begin, end - begin)
                    held.append([own.column(2).to_numpy(), own.column(3).to_numpy(), own.column(4).to_numpy(zero_copy_only=False)])
                    continue
                if known is None:
                    known = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.empty(0, np.int64)] * 2 + [np.empty(0, bool)]
                for k in range(begin, end):
                    pair, n = unpack(b.column(7)[k].as_py())
                    where = np.searchsorted(known[0], pair)
                    stop = np.cumsum(np.append(0, b.column(6)[k].values.to_numpy()))
                    best, count = (np.append(0, np.cumsum(n * known[x][where]))[stop] for x in (2, 1))
                    rows = b.column(5)[k].values
                    doc = {f.name: rows.field(j) for j, f in enumerate(rows.type)}
                    yield pa.RecordBatch.from_arrays([*[doc[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(np.diff(best)), pa.array(np.diff(count)), doc["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    ordered = told.unionByName(asks).repartition("part").sortWithinPartitions("part", "seq", "pair")
    return ordered.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def groups(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """The groups themselves: (doc_id, start, end, a_ids, b_ids), where bytes are counted in a space
    and the text.  With ``inline`` over both arrays they give the links."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(tokenizers)

        def step(kinds: pa.DataType, final: bool) -> Iterator[pa.RecordBatch]:
            cut = sweep.cut()
            if cut:
                base = np.array([sweep.docs[d].base for d in cut.doc])
                end = cut.end - base
                start = np.append(0, end[:-1])
                if len(cut.doc):
                    new = np.append(True, cut.doc[1:] != cut.doc[:-1])
                    start[new] = 0
                    start[0] = getattr(sweep.docs[cut.doc[0]], "upto", 0)
                sweep.docs[cut.doc[-1]].upto = int(end[-1])
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids.astype(np.int32))) for n, ids in ((cut.n_a, cut.a), (cut.n_b, cut.b))]
                yield pa.RecordBatch.from_arrays([pa.array([sweep.docs[d].doc_id for d in cut.doc], kinds), pa.array(start), pa.array(end), *lists], ["doc_id", "start", "end", "a_ids", "b_ids"])
            sweep.done(final)

        kinds = None
        for b in batches:
            kinds = b.schema.field("doc_id").type
            for r in _runs(iter([b])):
                if sweep.full():
                    yield from step(kinds, False)
                sweep.take(*r)
        if kinds:
            yield from step(kinds, True)

    return sorted_events(docs, tokenizers).mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, a_ids array<int>, b_ids array<int>")


def _empty_tables() -> None:
    for side in _WORKERS.values():
        side.words.empty()


worker_tables("alignment", _empty_tables)
