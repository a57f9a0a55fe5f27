"""Line dedup by pairwise alignment.

1. Lines are hashed, and with them the windows of a text: its shortest runs of
   lines that hold ``BLOCK_WORDS`` words, however short each line is.  A window
   that more than one text holds links each later text with its first holder
   (the smallest id).  The holders of a hot window are spread over many tasks.
2. Each linked pair is aligned with patience diff: lines that are unique in
   both texts are anchors, the longest chain of anchors in order of both texts
   is kept, equal lines next to anchors extend it, and the gaps are aligned
   again in the same way.  A gap without such lines is split at its heaviest
   common run (the most words, the first of several), as long as that has
   ``BLOCK_WORDS`` words; lighter runs of the gap could not be deleted.
3. Aligned runs of lines that are common to both texts and hold at least
   ``BLOCK_WORDS`` words are deleted from the later text.  Blocks are judged on
   the input, so a line stays in its first holder.
4. A later text may keep lines of a window that earlier texts hold (its lines
   may stand in another order in the first holder).  It is then held against
   every other earlier holder of that window.  What counts of a holder are the
   lines that the later text has too, so holders that look the same to it are
   aligned once.  The result is that of aligning all pairs: each line deleted by
   any pair is in a window of that pair.

Each pair is aligned once: of a passage that stands more often in the later text
than in an earlier one, as many copies leave as that alignment matches.

Defined results: of equal texts the one of the smallest id stays, the others
are one common block and lose all their lines (if they have ``BLOCK_WORDS``
words); null texts count as empty, and stay null where nothing is deleted; rows
with a null id are neither compared nor changed; rows with equal id and text are
the same document and treated alike, those with equal id and different texts are
not compared with each other; an empty table gives no rows; very long texts are
read whole; line ends are ``\\n``.  Extra columns are kept, whatever their names,
by ``without_common_blocks``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, arrow_rows, fresh, hot_keys, pick, salted_join, stored, take_worker

#: Lines of ``LINE_WORDS`` words link texts in the tests' brute force of first holders only.
LINE_WORDS, BLOCK_WORDS = 5, 10


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Signed 64-bit hash and number of words of each line."""
    lines = [line.strip() for line in text.split("\n")]
    h = [xxhash.xxh3_64_intdigest(line) for line in lines]
    return [x - (1 << 64) if x >> 63 else x for x in h], [len(line.split()) for line in lines]


def anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest chain of lines that are unique in both ranges."""
    ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {a[i]: i for i in range(a0, a1) if ca[a[i]] == 1 and cb.get(a[i]) == 1}
    tops: list[int] = []
    piles: list[tuple[int, int]] = []
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    for j in range(b0, b1):
        i = where.get(b[j])
        if i is None:
            continue
        k = bisect_left(tops, i)
        back[(i, j)] = piles[k - 1] if k else None
        if k == len(tops):
            tops.append(i)
            piles.append((i, j))
        else:
            tops[k], piles[k] = i, (i, j)
    out = []
    at = piles[-1] if piles else None
    while at is not None:
        out.append(at)
        at = back[at]
    return out[::-1]


def heaviest_run(a: list[int], b: list[int], weights: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """(weight, start in a, start in b, lines) of the heaviest common run of the
    ranges, the first one of several."""
    x, y, w = np.array(a[a0:a1], np.int64), np.array(b[b0:b1], np.int64), np.array(weights[b0:b1], np.int64)
    shared = np.isin(y, x)
    if not w[shared].any():
        return 0, a0, b0, 0
    rows = np.isin(x, y)
    best, at, ending = 0, (0, 0), np.zeros(b1 - b0 + 1, np.int64)
    for i in range(a1 - a0):
        if rows[i]:
            ending[1:] = np.where(y == x[i], ending[:-1] + w, 0)
            j = int(ending.argmax())
            if ending[j] > best:
                best, at = int(ending[j]), (a0 + i + 1, b0 + j)
        else:
            ending[:] = 0
    i, j = at
    n = 0
    while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
        n += 1
    return best, i, j, n


def align(a: list[int], b: list[int], words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Matched positions of two sequences by patience diff, in order.  Ranges
    without unique lines are split at their heaviest common run by the words of
    ``b`` (each line counts 1 where they are not given), if that has ``least``."""
    weights = [1] * len(b) if words is None else words
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        i0, j0 = a0, b0
        chain = anchors(a, b, a0, a1, b0, b1)
        if not chain:
            weight, i, j, n = heaviest_run(a, b, weights, a0, a1, b0, b1)
            if weight >= least:
                out += [(i + k, j + k) for k in range(n)]
                todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
            continue
        for i, j in [*chain, (a1, b1)]:
            todo.append((i0, i, j0, j))
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def common_blocks(first: list[int], later: list[int], later_words: list[int]) -> list[int]:
    """Lines of the later text in aligned common blocks of enough words."""
    out: list[int] = []
    run: list[int] = []
    at = (-2, -2)
    for i, j in [*align(first, later, later_words, BLOCK_WORDS), (-9, -9)]:
        if (i, j) != (at[0] + 1, at[1] + 1):
            if sum(later_words[k] for k in run) >= BLOCK_WORDS:
                out += run
            run = []
        run.append(j)
        at = (i, j)
    return out


def windows(hashes: list[int], words: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Places of the shortest runs of ``BLOCK_WORDS`` words from each line
    onwards and backwards, by hash.  Those inside a block cover it, so a block
    of two texts has windows that both hold."""
    n = len(hashes)
    places = set()
    ahead = back = 0
    end = start = 0
    for k in range(n):
        while end < n and ahead < BLOCK_WORDS:
            ahead += words[end]
            end += 1
        if ahead >= BLOCK_WORDS:
            places.add((k, end))
        ahead -= words[k]
        back += words[k]
        while back - words[start] >= BLOCK_WORDS:
            back -= words[start]
            start += 1
        if back >= BLOCK_WORDS:
            places.add((start, k + 1))
    out: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in sorted(places):
        x = xxhash.xxh3_64_intdigest(np.array(hashes[lo:hi], np.int64).tobytes())
        out.setdefault(x - (1 << 64) if x >> 63 else x, []).append((lo, hi))
    return out


def lined(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, hashes, words, windows) of every row with an id."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lines")
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            each = [line_hashes(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts], pa.string()), pa.array([h for h, _ in each], pa.list_(pa.int64())), pa.array([w for _, w in each], pa.list_(pa.int32())),
                    pa.array([list(windows(h, w)) for h, w in each], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "hashes", "words", "windows"],
            )

    return stored(pick(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, digest string, hashes array<bigint>, words array<int>, windows array<bigint>"), "lined")


def seen_from(hashes: list[int], lines: set[int], gap: int) -> tuple[int, ...]:
    """A text as those see it who hold only ``lines``: the others are gaps."""
    out: list[int] = []
    for h in hashes:
        if h in lines:
            out.append(h)
        elif not out or out[-1] != gap:
            out.append(gap)
    return tuple(out)


def further(holders: list[tuple[int, list[int]]], later: list[tuple[int, str, list[int], list[int], int, int]]) -> list[tuple[int, str, list[int]]]:
    """(doc_id, digest, gone) of the later texts (doc_id, digest, hashes, words,
    start and end of a window) against every earlier one of the holders
    (doc_id, hashes) of this window.  An alignment sees nothing of a holder but
    the lines that the later text has too, so holders that look the same are
    aligned once, and those that share nothing but the window all look like it,
    with or without a gap before and after it."""
    known = set().union(*(x[2] for x in later))
    gap = next(g for g in range(len(known) + 1) if g not in known)
    forms: dict[tuple[int, ...], int] = {}
    for i, h in sorted(holders, key=lambda x: x[0]):
        forms.setdefault(seen_from(h, known, gap), i)
    looks, ids = list(forms), list(forms.values())
    window = tuple(later[0][2][later[0][4] : later[0][5]])
    ends = [(form[: len(window)] != window, form[-len(window) :] != window) for form in looks]
    alike = {e: [k for k, x in enumerate(ends) if x == e] for e in set(ends)}
    having: dict[int, list[int]] = {}
    for k, form in enumerate(looks):
        for h, n in Counter(form).items():
            if h != gap and (n > 1 or h not in window):
                having.setdefault(h, []).append(k)
    out = []
    for i, digest, hashes, words, _, _ in later:
        own = set(hashes)
        before = bisect_left(ids, i)
        near = {k for h in own for k in having.get(h, ()) if k < before}
        seen = {seen_from(looks[k], own, gap) for k in near}
        nearby = Counter(ends[k] for k in near)
        for e, those in alike.items():
            if bisect_left(those, before) > nearby[e]:
                seen.add((gap,) * e[0] + window + (gap,) * e[1])
        gone = sorted({k for form in seen for k in common_blocks(list(form), hashes, words)})
        if gone:
            out.append((i, digest, gone))
    return out


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, copy, gone): whether the text equals an earlier one,
    and otherwise the numbers of the lines to delete."""
    rows = lined(docs)
    nodes = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    copies = rows.join(nodes, "digest").where("doc_id > node").select("doc_id", "digest").distinct().select("doc_id", "digest", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("gone"))
    texts = stored(rows.join(nodes.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"]), "texts")
    held = texts.select("doc_id", "digest", F.explode("windows").alias("window"))
    first = stored(held.groupBy("window").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1"), "first")
    hot = hot_keys(first, "window", "texts")
    links = salted_join(held, first.drop("texts"), "window", hot, "doc_id").where("first < doc_id")
    pairs = stored(links.groupBy("first", "doc_id", "digest").agg(F.collect_set("window").alias("shared")), "pairs")
    earlier = texts.select(F.col("doc_id").alias("first"), F.col("hashes").alias("first_hashes"))
    both = pairs.join(earlier, "first").join(texts.drop("windows"), ["doc_id", "digest"]).select("doc_id", "digest", "first_hashes", "hashes", "words", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lines")
        for b in batches:
            gone = [common_blocks(x, y, w) for x, y, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32())), b.column(5)], ["doc_id", "digest", "gone", "shared"])

    aligned = both.mapInArrow(run, "doc_id bigint, digest string, gone array<int>, shared array<bigint>")
    begun = stored(aligned.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared")), "begun")
    ended = begun.select("doc_id", "digest", "gone").unionByName(from_further(texts, held, begun, hot))
    united = ended.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")).where("size(gone) > 0")
    return stored(copies.unionByName(united.withColumn("copy", F.lit(False))), "deletions")


def from_further(texts: DataFrame, held: DataFrame, begun: DataFrame, hot: list) -> DataFrame:
    """(doc_id, digest, gone) from all other holders of the windows that earlier
    texts share and that the first holders left open."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lines")
        for b in batches:
            at, found = [], []
            for k, (hashes, words, gone, shared) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                lost, own = set(gone), windows(hashes, words)
                for x in shared:
                    if not all(lost.issuperset(range(lo, hi)) for lo, hi in own[x]):
                        at.append(k)
                        found.append((x, *own[x][0]))
            columns = [b.column(c).take(pa.array(at, pa.int64())) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32())))], ["doc_id", "digest", "hashes", "words", "window", "lo", "hi"])

    rows = begun.join(texts.drop("windows"), ["doc_id", "digest"]).select("doc_id", "digest", "hashes", "words", "gone", "shared")
    left = stored(rows.mapInArrow(kept, "doc_id bigint, digest string, hashes array<bigint>, words array<int>, window bigint, lo int, hi int"), "open")
    is_hot = F.col("window").isin(hot)
    dealt = held.join(left.select("window").distinct(), "window", "left_semi").join(texts.select("doc_id", "digest", "hashes"), ["doc_id", "digest"])
    dealt = dealt.select("doc_id", "hashes", "window", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    copied = left.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))

    def run(holders: pa.Table, later: pa.Table) -> pa.Table:
        take_worker("lines")
        found = []
        if holders.num_rows and later.num_rows:
            found = further(list(zip(*(holders[c].to_pylist() for c in ("doc_id", "hashes")), strict=True)), list(zip(*(later[c].to_pylist() for c in ("doc_id", "digest", "hashes", "words", "lo", "hi")), strict=True)))
        return pa.table([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int32())))], ["doc_id", "digest", "gone"])

    return dealt.groupBy("window", "salt").cogroup(copied.groupBy("window", "salt")).applyInArrow(run, "doc_id bigint, digest string, gone array<int>")


def annotated(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with three columns of the given names: the kept text, lines
    before, and lines deleted."""
    arrow_rows(docs.sparkSession)
    at_id, at_digest, at_md5, at_copy, at_gone = (fresh(docs, f"gone_{c}") for c in ("id", "digest", "md5", "copy", "lines"))
    gone = deletions(docs).select(F.col("doc_id").alias(at_id), F.col("digest").alias(at_digest), F.col("copy").alias(at_copy), F.col("gone").alias(at_gone))
    rows = docs.withColumn(at_md5, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(gone, (docs["doc_id"] == F.col(at_id)) & (F.col(at_md5) == F.col(at_digest)), "left").drop(at_id, at_digest, at_md5)
    own = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())]
    schema = T.StructType([*docs.schema.fields, *own])
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lines")
        for b in batches:
            kept, before, removed = [], [], []
            for text, copy, lost in zip(b.column(at).to_pylist(), b.column(width).to_pylist(), b.column(width + 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                before.append(len(lines))
                if copy and len((text or "").split()) >= BLOCK_WORDS:
                    kept.append("")
                    removed.append(len(lines))
                elif lost:
                    drop = set(lost)
                    kept.append("\n".join(line for k, line in enumerate(lines) if k not in drop))
                    removed.append(len(drop))
                else:
                    kept.append(text)
                    removed.append(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def without_common_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with the shortened texts; n_chars, where present, follows."""
    text, before, removed = (fresh(docs, f"kept_{c}") for c in ("text", "lines", "removed"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(text).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col(removed) > 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return annotated(docs, (text, before, removed)).select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: lines, deleted lines, and size and digest of what is kept."""
    kept = F.coalesce("kept_text", F.lit(""))
    return annotated(pick(docs, "doc_id", "text"), ("kept_text", "kept_lines", "kept_removed")).select("doc_id", F.col("kept_lines").alias("n_lines"), F.col("kept_removed").alias("n_removed"), F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))
