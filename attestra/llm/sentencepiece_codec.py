"""SentencePiece BPE encoding and decoding through a prefix table.

A BPE encoding has two properties which make a table over prefixes enough:

* cutting an encoding after any token leaves the encoding of the text before
  the cut, so every prefix of a text has one last token;
* a token sequence is an encoding exactly if each pair of neighbours is one
  (the pair is *compatible*: merging the pair's text yields the pair again).

So for every prefix, the tokens that end there (found by an Aho-Corasick
automaton, longest first) are tried, and the one that is compatible with the
last token of the prefix before it is stored.  The ids are recovered from the
last prefix backwards.

Texts are cut where no piece of the vocabulary can cross (the set of adjacent
character pairs inside pieces decides, nothing is assumed), so that the tables
of frequent words are kept and reused.

Defined results: null text counts as empty; an empty text encodes to the end
id alone and decodes to the empty text.  Very long texts are walked in linear
time.  Ties between equal merges go to the leftmost, as in the library.  Repeated
rows, and rows with a null id, give a row each; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, pick, take_worker, worker_tables

SPACE = "▁"
#: Entries of the word and pair tables of one worker before they are emptied.
CACHE_WORDS, CACHE_PAIRS, CACHE_LENGTH = 140_000, 250_000, 40

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder for one model file (identity normaliser, BPE)."""

    _open: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._open:
            gc.set_threshold(500_000, 50, 100)  # the tables hold no cycles
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("an identity normaliser that keeps white space is needed")
        self.dummy_prefix = norm.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        self.piece_id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.decode_byte: dict[int, int] = {}
        self.surface: dict[int, str] = {}
        self.eos = model.trainer_spec.eos_id
        for i, p in enumerate(model.pieces):
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED):
                if p.type != kinds.NORMAL:
                    raise ValueError("user-defined and unused pieces are not supported")
                self.piece_id[p.piece] = i
                self.score[p.piece] = p.score
                self.surface[i] = p.piece.replace(SPACE, " ")
            elif p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.decode_byte[i] = int(p.piece[3:5], 16)
        self.pairs_inside = {p[i : i + 2] for p in self.piece_id for i in range(len(p) - 1)}
        # Words begin at a run of spaces and end before the next one, if no piece has a space after another character.
        whole = all(b[1] != SPACE or b[0] == SPACE for b in self.pairs_inside)
        alone = "\n" if not any("\n" in p for p in self.piece_id) else ""
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}+" if alone else "")) if whole else re.compile("(?s).+")
        self.automaton = ahocorasick.Automaton()
        for p in self.piece_id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.shown = {p: (str(i), self.surface[i]) for p, i in self.piece_id.items()}

    def merge(self, text: str) -> list[str]:
        """Plain BPE: merge the neighbours of highest score, leftmost first."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the text of two tokens yields the two again (``a``
        is empty where a text begins)."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text by the prefix table."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        get, fits = self.compatible.get, self.fits
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(piece)
            before = last[start] if start else ""
            if before is None:
                # no piece ends there: a character outside the vocabulary stands alone
                before = last[start] = text[start - 1]
            known = get((before, piece))
            if known or (known is None and fits(before, piece)):
                last[end] = piece
        out, at = [], n
        while at > 0:
            token = last[at] or text[at - 1]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for t in tokens:
            i = self.piece_id.get(t)
            if i is None:
                out += [self.byte_id[b] for b in t.encode()]
            else:
                out.append(i)
        return out

    def surfaces(self, ids: list[int]) -> str:
        """The text of ids as they stand inside a sequence."""
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.decode_byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(self.surface.get(i, ""))
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts)

    def empty(self) -> None:
        self.words, self.older = {}, {}
        self.compatible.clear()

    def word(self, chunk: str) -> tuple:
        """(ids as text, their number) of a chunk that no piece crosses; the
        decoded text follows if decoding doesn't give the chunk itself.
        Words used since the table was last full are kept."""
        found = self.older.get(chunk)
        if found is None:
            tokens = self.tokens(chunk)
            try:
                each = [self.shown[t] for t in tokens]
                found = (" ".join([e[0] for e in each]), len(each), "".join([e[1] for e in each]))
            except KeyError:  # characters that are spelled in bytes
                ids = self.ids(tokens)
                found = (" ".join(map(str, ids)), len(ids), self.surfaces(ids))
            if found[2] == chunk.replace(SPACE, " "):
                found = found[:2]
        if len(chunk) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[chunk] = found
        return found

    def chunks(self, text: str) -> tuple[list[str], list[tuple]]:
        """The chunks of a text and what is known of each."""
        if not text:
            return [], []
        norm = text.replace(" ", SPACE)
        if self.dummy_prefix:
            norm = SPACE + norm
        get, word = self.words.get, self.word
        cut = self.cut.findall(norm)
        return cut, [get(c) or word(c) for c in cut]

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text with the end id."""
        return [int(i) for c in self.chunks(text or "")[1] for i in c[0].split()] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        text = self.surfaces(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text)."""
        cut, chunks = self.chunks(text or "")
        ids = " ".join([*[c[0] for c in chunks], str(self.eos)])
        decoded = "".join([c if len(x) == 2 else x[2] for c, x in zip(cut, chunks, strict=True)]).replace(SPACE, " ")
        if self.dummy_prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum([c[1] for c in chunks]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, decoded text) of each text: the operator's general form."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("sentencepiece")
        codec = Codec.of(model)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    return pick(docs, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("sentencepiece")
        codec = Codec.of(model)
        for b in batches:
            rows = [codec.digest(t) for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def _empty_tables() -> None:
    for codec in Codec._open.values():
        codec.empty()


worker_tables("sentencepiece", _empty_tables)
