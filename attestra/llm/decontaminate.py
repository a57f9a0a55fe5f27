"""Benchmark decontamination with suffix arrays over shards of the training text.

Each shard (the documents of one Arrow batch, in slices of bounded size) becomes
a word-level suffix array; every suffix of every benchmark item is searched in
it by bisection, to the depth of a window.  A suffix of the training text can
only match if all words of a window are words of the benchmark, so the array
holds just the suffixes that start such a run: nothing that could match is left
out.  Where a suffix is found and the word before it differs (else a longer match
starts earlier), the match is extended to its end: each item's longest verbatim
match of a document is kept with its places in both.

Words: A-Z are lower-cased; a word is a run of digits, letters a-z and
characters beyond ASCII.  A window is ``window`` consecutive words of an item;
an item of fewer words, but not none, is one window.  A word of a document is
hit if it lies in an occurrence of a window.

The benchmark is read in blocks of at most ``block_bytes`` of text; each block
is broadcast and searched in one narrow pass, which hands its findings to the
next pass in the row itself.  Between blocks the rows are stored and the block
is dropped, so one block is held at a time.  No pass shuffles.

Defined results: null texts have no words; items with a null text are ignored;
a null item id is named ``null``; repeated documents and items are judged each
on its own; with no benchmark nothing is hit; very long texts are read whole; of
equally long matches of an item the first in the document counts, then the first
in the item.  Extra columns are ignored, or kept, whatever their names, where
documents are filtered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, byte_slices, fresh, pick, stored, take_worker

WINDOW, BLOCK_BYTES = 10, 16 << 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


class Windows:
    """The suffixes of one block of items, as keys that sort like their words."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        found: dict[tuple[int, ...], list[int]] = defaultdict(list)
        parts, begin = [[0]], [1]
        for _, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1 if ids else 0):
                found[tuple(ids[i : i + width])].append(begin[-1] + i)
            parts.append([*ids, 0])
            begin.append(begin[-1] + len(ids) + 1)
        #: the items' words, with 0 before, between and after them; where items begin
        self.text = np.array([w for p in parts for w in p], np.uint32)
        self.begin = np.array(begin[:-1], np.int64)
        self.keys = sorted(found)
        self.places = [np.array(found[k], np.int64) for k in self.keys]
        self.items = [sorted({self.names[j] for j in np.unique(np.searchsorted(self.begin, p, "right") - 1)}) for p in self.places]
        self.lengths = np.array([len(k) for k in self.keys], np.int64)
        low = np.zeros((len(self.keys), window), ">u4")
        high = low.copy()
        for i, k in enumerate(self.keys):
            low[i, : len(k)] = high[i, : len(k)] = k
            high[i, len(k) - 1] += 1
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{4 * window}").ravel() for x in (low, high))
        self.shortest = int(self.lengths.min()) if self.keys else 0


#: A longest match: words, place in the document, place in the item.
Match = tuple[int, int, int]
#: Pairs of places that are looked at together.
PAIRS = 1 << 16


def better(a: Match | None, b: Match) -> Match:
    return b if a is None or (-b[0], b[1], b[2]) < (-a[0], a[1], a[2]) else a


def extended(ids: np.ndarray, places: np.ndarray, k: int, bench: Windows) -> Iterator[tuple[int, int, int]]:
    """(place, place in the items' text, words) of the maximal matches that begin
    with window k at some of the places."""
    occurrences, step = bench.places[k], max(1, PAIRS // len(bench.places[k]))
    before = bench.text[occurrences - 1]
    for s in range(0, len(places), step):
        part = places[s : s + step]
        mine = np.where(part > 0, ids[part - 1], 0)
        i, j = np.nonzero((mine[:, None] != before) | (mine[:, None] == 0))
        p, b = part[i], occurrences[j]
        length = np.full(len(p), bench.lengths[k])
        on = np.arange(len(p))
        while len(on):
            x, y = ids[p[on] + length[on]], bench.text[b[on] + length[on]]
            on = on[(x == y) & (x != 0)]
            length[on] += 1
        yield from zip(p.tolist(), b.tolist(), length.tolist(), strict=True)


def search(texts: list[str | None], bench: Windows) -> list[tuple[int, list[int], dict[str, Match]]]:
    """Per text: number of words, hit spans as start, end, ..., and for each item
    found its longest match."""
    known = bench.vocabulary
    sizes, parts = [], []
    for t in texts:
        w = words(t)
        sizes.append(len(w))
        parts.append(np.fromiter((known.get(x, 0) for x in w), np.uint32, len(w)))
        parts.append(np.zeros(1, np.uint32))  # no suffix runs on into the next text
    spans: list[list[int]] = [[] for _ in texts]
    items: list[dict[str, Match]] = [{} for _ in texts]
    if bench.keys and texts:
        ids = np.concatenate([*parts, np.zeros(bench.window, np.uint32)])
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        zeros = np.flatnonzero(ids == 0)
        at = np.flatnonzero(ids)
        run = zeros[np.searchsorted(zeros, at)] - at
        at, run = at[run >= bench.shortest], run[run >= bench.shortest]
        if len(at):
            key = ids[at[:, None] + np.arange(bench.window)]
            key[np.arange(bench.window) >= run[:, None]] = 0
            key = np.ascontiguousarray(key.astype(">u4")).view(f"S{4 * bench.window}").ravel()
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            lo, hi = np.searchsorted(ranked, bench.low), np.searchsorted(ranked, bench.high)
            cover = np.zeros(len(ids) + 1, np.int32)
            for k in np.flatnonzero(hi > lo):
                places = at[order[lo[k] : hi[k]]]
                np.add.at(cover, places, 1)
                np.add.at(cover, places + bench.lengths[k], -1)
                for p, b, length in extended(ids, places, k, bench):
                    d, item = int(np.searchsorted(starts, p, "right")) - 1, int(np.searchsorted(bench.begin, b, "right")) - 1
                    name = bench.names[item]
                    items[d][name] = better(items[d].get(name), (length, p - int(starts[d]), b - int(bench.begin[item])))
            hit = np.cumsum(cover) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
            if len(edges):
                owner = np.searchsorted(starts, edges[::2], "right") - 1
                for d, s, e in zip(owner, edges[::2], edges[1::2], strict=True):
                    spans[d] += [int(s - starts[d]), int(e - starts[d])]
    return list(zip(sizes, spans, items, strict=True))


def merged(spans: list[int]) -> list[int]:
    """Spans united, in order."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(bench: DataFrame, window: int, block_bytes: int) -> Iterator[Windows]:
    """The items by blocks whose text has a bounded size each."""
    items = pick(bench, "item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Windows([("null" if i is None else str(i), t) for i, t in part.toLocalIterator()], window)


MATCH = T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("item_place", T.IntegerType())])


def annotate(docs: DataFrame, bench: DataFrame, names: tuple[str, str, str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """``docs`` with three columns of the given names: number of words, hit word
    spans, and for each item found (sorted) its longest match."""
    spark = docs.sparkSession
    arrow_rows(spark)
    own = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(MATCH))]
    first, out = len(docs.columns), docs
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *own])
    kind = pa.list_(pa.struct([("item", pa.string()), ("words", pa.int32()), ("place", pa.int32()), ("item_place", pa.int32())]))
    used = None
    for k, block in enumerate(blocks(bench, window, block_bytes)):
        if used is not None:
            out = stored(out, "found")
            used.unpersist()
        used = sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, again=k > 0) -> Iterator[pa.RecordBatch]:
            take_worker("decontaminate")
            for whole in batches:
                for b in byte_slices(whole, at):
                    n, spans, items = [], [], []
                    for i, (size, s, found) in enumerate(search(b.column(at).to_pylist(), sent.value)):
                        if again:
                            s = s + b.column(first + 1)[i].as_py()
                            for x in b.column(first + 2)[i].as_py():
                                found[x["item"]] = better(found.get(x["item"]), (x["words"], x["place"], x["item_place"]))
                        n.append(size)
                        spans.append(merged(s))
                        items.append([{"item": x, "words": m[0], "place": m[1], "item_place": m[2]} for x, m in sorted(found.items())])
                    columns = [*b.columns[:first], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, kind)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        out = out.mapInArrow(run, schema)
    return out


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document what was found, one row for each row of ``docs``; the last
    columns state the longest verbatim match and where it stands."""
    arrow_rows(docs.sparkSession)
    found = annotate(pick(docs, "doc_id", "text"), bench, ("words", "spans", "matches"), window).drop("text")
    lengths = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.get("spans", i + 1) - F.get("spans", i))
    lengths = F.when(F.size("spans") > 0, lengths).otherwise(F.array().cast("array<int>"))
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    longest = F.array_min(F.transform("matches", lambda m: F.struct((-m["words"]).alias("less"), m["place"].alias("place"), m["item"].alias("item"), m["item_place"].alias("item_place"))))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.col("words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join("matches.item", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(-F.col("longest.less"), F.lit(0)).cast("long").alias("longest_match"),
        F.col("longest.item").alias("longest_item"),
        F.col("longest.place").cast("long").alias("longest_place"),
        F.col("longest.item_place").cast("long").alias("longest_item_place"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which nothing was found."""
    names = tuple(fresh(docs, c) for c in ("found_words", "found_spans", "found_items"))
    return annotate(docs, bench, names, window).where(F.size(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
