"""Removal of repeated 100-byte strings by sampled prefix doubling.

Prefix doubling ranks every position by its next 1, 2, 4, ... bytes, each rank
from a pair of ranks at a growing offset, until ranks are unique or the length
is past the threshold.  Sorting a row for every byte of the corpus at every
length moves many times the input, so ranks are kept where they are needed:

* Ranks up to 32 bytes are named by fingerprints, doubled inside a document.
* Of each 100-byte window the 32-byte string of least fingerprint is its anchor
  (the leftmost, if several are equal), so equal windows have equal anchors at
  equal offsets.  About one position in 35 is an anchor of some window.
* First sort across documents: anchors by (rank at the anchor, rank of all text
  that the anchor's windows cover).  A unique anchor ends there.  An anchor
  whose covered text began earlier elsewhere is done too: all its windows
  repeat.  The first one of each covered text goes on if its anchor has other
  covered texts.
* Second sort: the windows of those that go on, by (anchor rank, rank of the
  100 bytes, doubled from 64 bytes at offsets 0 and 36).  All but the first of
  equal windows repeat.

Every string that the plain method would find is found: the sample depends on
the window's bytes alone.  Documents are kept in one table bucketed by part; the
passes over it do not shuffle texts.  A part (``BUCKET_BYTES`` of text) is worked
on in groups of ``GROUP_BYTES``.  A group sends each distinct rank pair once, so a
passage in a third of all documents travels once for each group, not for each
document; what a part's groups send to one bucket is one row.  There are as many
parts and buckets as the bytes (or the shuffle partitions) ask for.

Defined results: null text counts as empty; rows with a null id are neither
compared nor changed; rows of equal id are compared by start alone, so neither
of two equal rows removes the other; texts under 100 bytes keep all bytes; an
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, new_path, pick, stored

LENGTH, ANCHOR = 100, 32
REACH = LENGTH - ANCHOR + 1
GROUP_BYTES, BUCKET_BYTES, PIECE = 4 << 20, 64 << 20, 1 << 17
#: Places that fit beside the leading bits of a fingerprint.
PLACES = 1 << 24

U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _A)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, all first bytes together, then all second ones, and
    so on: sorted ranks and small numbers then compress well."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=n * sum(sizes), asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of two ranks, by name."""
    x = a * _A
    x += b
    x ^= x >> U(29)
    x *= _B
    return x


def doubled(data: np.ndarray, length: int = ANCHOR) -> np.ndarray:
    """Ranks of the ``length`` bytes from each position (a power of two)."""
    h, size = _BYTE[data], 1
    while size < length:
        h = pair(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    return h


class Group:
    """The documents of one group: anchors and ranks, in order of id and start."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] or b"" for i in order]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        n = int(self.begin[-1])
        self.h = np.empty(n, np.uint64)
        found = [self._anchors(a, b) for a, b in self._pieces()]
        doc, first, last, anchor = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        self.doc, self.first, self.last = doc, first, last
        self.k = _mix(self.h[anchor])  # anchors have small fingerprints; buckets need even ones
        # the rank of all covered text: its first and last window, and how they lie
        shape = ((last - first) * 128 + anchor - first).astype(np.uint64)
        self.x = _mix(pair(self.window(first), self.window(last)) + shape * _A)

    def _pieces(self) -> list[tuple[int, int]]:
        """Ranges of whole documents of about ``PIECE`` bytes."""
        out, a = [], 0
        for b in range(1, len(self.texts) + 1):
            if self.begin[b] - self.begin[a] >= PIECE or b == len(self.texts):
                out.append((a, b))
                a = b
        return out

    def _anchors(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of the documents a to b, and their anchors: document, first
        and last window, and place of the anchor."""
        low = int(self.begin[a])
        h = doubled(np.frombuffer(b"".join(self.texts[a:b]), np.uint8))
        self.h[low : low + len(h)] = h
        none = np.zeros(0, np.int64)
        if len(h) < REACH:
            return none, none, none, none
        out = []
        for c in range(0, len(h) - REACH + 1, PLACES - REACH):
            m = (h[c : c + PLACES - 1] & ~U(PLACES - 1)) | np.arange(min(PLACES - 1, len(h) - c), dtype=np.uint64)
            width = 1
            while width * 2 <= REACH:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            m = np.minimum(m[: len(m) - (REACH - width)], m[REACH - width :])
            out.append((m & U(PLACES - 1)).astype(np.int32) + c)
        q = np.concatenate(out) if len(out) > 1 else out[0]
        inside = np.zeros(len(q), bool)
        new = np.empty(len(q), bool)
        new[0] = True
        np.not_equal(q[1:], q[:-1], out=new[1:])
        stop = np.zeros(len(q) + 1, bool)
        for d in range(a, b):
            s, e = int(self.begin[d]) - low, int(self.begin[d + 1]) - low - LENGTH + 1
            if e > s:
                inside[s:e] = True
                new[s] = True
                stop[e] = True
        at = np.flatnonzero(new & inside)
        bound = np.flatnonzero(np.concatenate([new, [True]]) | stop)
        last = bound[np.searchsorted(bound, at, "right")] - 1
        doc = np.searchsorted(self.begin, at + low, "right") - 1
        return doc, at + low, last + low, q[at].astype(np.int64) + low

    def window(self, p: np.ndarray) -> np.ndarray:
        """Ranks of the 100 bytes from each position."""

        def half(at):
            return pair(self.h[at], self.h[at + ANCHOR])

        return pair(half(p), half(p + LENGTH - 2 * ANCHOR))

    def key(self, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[doc], p - self.begin[doc]

    def representatives(self, k: np.ndarray, x: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equal rank pairs the first: its index, for each sorted pair; the
        pair's number for every row; and which rows start after their first."""
        order = np.lexsort((x, k))
        new = np.ones(len(order), bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (x[order][1:] != x[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        mine, start = self.key(doc, p)
        base = first[number]
        return first, number, (mine > mine[base]) | (start > start[base])

    def messages(self, g: int, buckets: int, k: np.ndarray, x: np.ndarray, doc: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
        """Sorted rank pairs with their places, packed for each bucket: bucket,
        group, place of the first pair, number of pairs, pairs."""
        if not len(k):
            return []
        mine, start = self.key(doc, p)
        to = ((k >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        end = np.concatenate([cut[1:], [len(to)]]).astype(np.int64)
        start = start.astype(np.int32)
        blobs = [pack(k[a:b], x[a:b], mine[a:b], start[a:b]) for a, b in zip(cut, end, strict=False)]
        return [(int(bucket), g, int(a), int(b - a), blob) for bucket, a, b, blob in zip(to[cut], cut, end, blobs, strict=True)]


MESSAGE = "bucket int, sent array<struct<g:int,begin:bigint,n:int,blob:binary>>"
REPLY = "part int, g int, level int, places binary, open boolean"
_SENT = pa.list_(pa.struct([("g", pa.int32()), ("begin", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())]))


def _groups(table: pa.Table) -> Iterator[tuple[int, Group]]:
    """The groups of a part, one at a time."""
    if table.num_rows:
        of = table.column("g").to_numpy()
        for g in np.unique(of):
            mine = table.filter(pa.array(of == g))
            yield int(g), Group(mine.column("doc_id").to_pylist(), mine.column("text").to_pylist())


def _by_bucket(messages: list[tuple[int, int, int, int, bytes]]) -> pa.Table:
    """What the groups of a part send, one row for each bucket."""
    rows: dict[int, list[dict]] = {}
    for bucket, g, begin, n, blob in messages:
        rows.setdefault(bucket, []).append({"g": g, "begin": begin, "n": n, "blob": blob})
    return pa.table({"bucket": pa.array(list(rows), pa.int32()), "sent": pa.array(list(rows.values()), _SENT)})


def _answers(level: int, parts: int):
    """A bucket's work: for every rank pair, whether it began earlier."""

    def run(table: pa.Table) -> pa.Table:
        k, x, d, s, g, place = [], [], [], [], [], []
        for m in (m for sent in table.column("sent") for m in sent.as_py()):
            source, begin, n, blob = m["g"], m["begin"], m["n"], m["blob"]
            for held, part in zip((k, x, d, s), unpack(blob, n, np.uint64, np.uint64, np.int64, np.int32), strict=True):
                held.append(part)
            g.append(np.full(n, source, np.int32))
            place.append(np.arange(begin, begin + n))
        k, x, d, s, g, place = (np.concatenate(v) for v in (k, x, d, s, g, place))
        if level == 0:  # unique anchors end here
            _, number, count = np.unique(k, return_inverse=True, return_counts=True)
            more = count[number] > 1
            k, x, d, s, g, place = (v[more] for v in (k, x, d, s, g, place))
        order = np.lexsort((s, d, x, k))
        k, x, d, s, g, place = (v[order] for v in (k, x, d, s, g, place))
        new_k = np.ones(len(k), bool)
        new_k[1:] = k[1:] != k[:-1]
        new = new_k.copy()
        new[1:] |= x[1:] != x[:-1]
        base = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        later = (d != d[base]) | (s != s[base])
        texts = np.add.reduceat(new, np.flatnonzero(new_k)) if len(k) else np.zeros(0)
        going_on = ~later & (texts[np.cumsum(new_k) - 1] > 1) if level == 0 else np.zeros(len(k), bool)
        out = {"g": [], "level": [], "places": [], "open": []}
        for flag, on in ((False, later), (True, going_on)):
            at = np.flatnonzero(on)
            at = at[np.argsort(g[at], kind="stable")]
            cut = np.flatnonzero(np.diff(g[at], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(at)], strict=False):
                out["g"].append(int(g[at[a]]))
                out["level"].append(level)
                out["places"].append(np.sort(place[at[a:b]]).astype(np.int32).tobytes())
                out["open"].append(flag)
        return pa.table({"part": pa.array([g % parts for g in out["g"]], pa.int32()), "g": pa.array(out["g"], pa.int32()), "level": pa.array(out["level"], pa.int32()), "places": pa.array(out["places"], pa.binary()), "open": pa.array(out["open"], pa.bool_())})

    return run


def _first_messages(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for g, group in _groups(table):
            first, _, _ = group.representatives(group.k, group.x, group.doc, group.first)
            out += group.messages(g, buckets, group.k[first], group.x[first], group.doc[first], group.first[first])
        return _by_bucket(out)

    return run


class Told:
    """The replies to a part: places of rank pairs by group, level and kind."""

    def __init__(self, replies: pa.Table) -> None:
        self.parts: dict[tuple, list[np.ndarray]] = {}
        if not replies.num_rows:
            return
        for *key, places in zip(*(replies.column(c).to_pylist() for c in ("g", "level", "open", "places")), strict=True):
            self.parts.setdefault(tuple(key), []).append(np.frombuffer(places, np.int32))

    def __call__(self, g: int, level: int, is_open: bool) -> np.ndarray:
        return np.concatenate(self.parts.get((g, level, is_open), [np.zeros(0, np.int32)]))


class Windows:
    """The windows of a group's anchors that went on to the second sort."""

    def __init__(self, group: Group, first: np.ndarray, going_on: np.ndarray) -> None:
        at = np.sort(first[going_on])
        count = group.last[at] - group.first[at] + 1
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.p = np.repeat(group.first[at], count) + step
        self.doc = np.repeat(group.doc[at], count)
        self.k = np.repeat(group.k[at], count)
        self.x = group.window(self.p)
        self.first, self.number, self.later = group.representatives(self.k, self.x, self.doc, self.p)


def _second_messages(buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        out, told = [], Told(replies)
        for g, group in _groups(table) if replies.num_rows else ():
            first, _, _ = group.representatives(group.k, group.x, group.doc, group.first)
            w = Windows(group, first, told(g, 0, True))
            out += group.messages(g, buckets, w.k[w.first], w.x[w.first], w.doc[w.first], w.p[w.first])
        return _by_bucket(out)

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removals(table: pa.Table, replies: pa.Table) -> pa.Table:
    """Per document what is removed and what is kept."""
    told = Told(replies)
    return pa.concat_tables([KEPT.empty_table(), *(_of_group(g, group, told) for g, group in _groups(table))])


def _of_group(g: int, group: Group, told: Told) -> pa.Table:
    first, number, later = group.representatives(group.k, group.x, group.doc, group.first)
    again = np.zeros(len(first), bool)
    again[told(g, 0, False)] = True
    whole = later | again[number]
    edge = np.zeros(int(group.begin[-1]) + 1, np.int32)
    np.add.at(edge, group.first[whole], 1)
    np.add.at(edge, group.last[whole] + LENGTH, -1)
    w = Windows(group, first, told(g, 0, True))
    again = np.zeros(len(w.first), bool)
    again[told(g, 1, False)] = True
    single = w.later | again[w.number]
    np.add.at(edge, w.p[single], 1)
    np.add.at(edge, w.p[single] + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for i, text in enumerate(group.texts):
        mine = gone[group.begin[i] : group.begin[i + 1]]
        removed = int(mine.sum())
        kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if removed else text
        out["n_removed"].append(removed)
        out["n_spans"].append(int(np.count_nonzero(mine[1:] & ~mine[:-1]) + (removed > 0 and mine[0])))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept)
    return pa.table({"doc_id": pa.array(group.ids, pa.int64()), "n_bytes": pa.array(group.size, pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})


def _digests(table: pa.Table, replies: pa.Table) -> pa.Table:
    told, form = Told(replies), KEPT.empty_table().drop_columns(["kept"])
    return pa.concat_tables([form, *(_of_group(g, group, told).drop_columns(["kept"]) for g, group in _groups(table))])


DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _release(df: DataFrame) -> None:
    """Let Spark drop shuffle files that no frame refers to any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def dedup(docs: DataFrame, keep_bytes: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document bytes, removed bytes, removed runs and the digest of the
    kept bytes; with ``keep_bytes`` the kept bytes too."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    parts = buckets = max(1, min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))))
    name = f"attestra_{uuid.uuid4().hex}"
    grouped = rows.where("doc_id is not null").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).withColumn("part", F.col("g") % parts)
    grouped.repartition(parts, "part").write.bucketBy(parts, "part").option("compression", "zstd").option("path", new_path(spark, "texts")).saveAsTable(name)
    try:
        texts = spark.table(name)
        _release(docs)
        first = texts.groupBy("part").applyInArrow(_first_messages(buckets), MESSAGE)
        replies = stored(first.groupBy("bucket").applyInArrow(_answers(0, parts), REPLY), "replies")
        del first
        _release(docs)
        second = texts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_second_messages(buckets), MESSAGE)
        more = stored(second.groupBy("bucket").applyInArrow(_answers(1, parts), REPLY), "replies")
        del second
        _release(docs)
        done = texts.groupBy("part").cogroup(replies.unionByName(more).groupBy("part"))
        found = stored(done.applyInArrow(_removals, f"{DIGESTS}, kept binary") if keep_bytes else done.applyInArrow(_digests, DIGESTS), "removals")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files are in the shared folder
    alone = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    return found.unionByName(alone if keep_bytes else alone.drop("kept"))
