"""Grouping of spelling variants by rolling-hash deletion keys.

Two words are near if one character is inserted, deleted or replaced between
them.  Every word has a key for each text that deleting one of its characters
leaves, and one for itself.  The key is a polynomial hash of that text: with the
sums ``P[i]`` over the characters before ``i`` and ``S[i]`` over those from ``i`` on, the
hash without character ``i`` is ``P[i] + S[i+1] / base``, so that all keys of all words
of one length are a few NumPy operations on a matrix.

Spark deals the keys by their leading bits and sorts them; one pass over a
sorted partition finds

* words with one key at one place (they differ in that character alone), and
* words whose key is that of a whole word (a character more).

Keys that nobody shares end there.  For the others the words are joined, and
strings decide: replacements are grouped by the text without the character, and a
deletion must give the other word, so a collision of hashes changes nothing.

No group is expanded into pairs: of the ``g`` words that differ in one place each has
``g - 1`` near words, and the heaviest of them is the first or the second of the
group.  Pairs of words differ in one place only, so they count once.

What a word's *form* is follows from the heaviest near word; *roots* by doubling
pointers: weights grow tenfold along a chain, so nineteen steps reach any end.

Shuffles: word counts (summed before in each task), keys (numbers, about one for a
character of the vocabulary), words of shared keys.  A word may be of any length:
its keys are numbers, its string travels with shared keys alone.

Defined results: null texts have no words; a null id counts as the empty string;
repeated rows count as often as they occur; ties of weight go to the least word in
code-point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, pick, stored, take_worker

#: Words that one task counts before it hands them on, and characters hashed at once.
TALLY_WORDS, HASH_CHARS = 300_000, 1 << 20
#: Least length and number of a word, deletions in one of so many runs, least ratio
#: of a form's number to the word's.
LEAST_LENGTH, LEAST_N, ONE_IN, RATIO = 7, 2, 31, 10
#: Doublings that follow 2 ** 5 steps; ``RATIO`` ** 19 is more than a long can hold.
DOUBLINGS = 5
WHOLE = -1  # the place of a word's own key

_RUNS = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def observed(run: str, doc: str) -> str:
    """The word that a lower-cased run of a document counts as: one of 31 loses a character."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``LEAST_LENGTH`` characters and how often they occur.
    Shorter runs can't become such words, so runs of that length are looked for."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("spelling")
        tally: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], ["word", "n"])
            tally.clear()
            return made

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                own: Counter[str] = Counter()
                for found, n in Counter(_RUNS.findall(text)).items():
                    own[found.lower() if found.isascii() else found.translate(_LOWER)] += n
                for found, n in own.items():
                    word = observed(found, doc)
                    if len(word) >= LEAST_LENGTH:
                        tally[word] += n
                if len(tally) >= TALLY_WORDS:
                    yield out()
        if tally:
            yield out()

    ids = docs.select(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")).alias("doc_id"), F.col("`text`").alias("text"))
    return ids.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(chars: np.ndarray) -> np.ndarray:
    """Keys of words of one length: ``chars`` has a row of code points for each word; the
    result has a key for each deleted character, and at last the word's own."""
    rows, length = chars.shape
    power = np.ones(length, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(length - 1, _BASE, np.uint64))
    weighed = chars * power
    upto = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(weighed, axis=1, out=upto[:, 1:])
    keys = np.empty((rows, length + 1), np.uint64)
    keys[:, :-1] = upto[:, :-1] + (upto[:, -1:] - upto[:, 1:]) * np.uint64(_INVERSE)
    keys[:, -1] = upto[:, -1]
    # the bits are spread, so that the leading ones deal evenly
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    return keys


def keys_of(words: DataFrame) -> DataFrame:
    """(key, at, wid, first): a row for each place of each word (wid, word), and one for
    the word; ``first`` where no equal character stands before, as deleting any of
    several equal neighbours gives one text."""
    arrow_rows(words.sparkSession, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("spelling")
        for b in batches:
            wid = b.column(0).to_numpy()
            texts = b.column(1).to_pylist()
            length = np.array([len(t) for t in texts])
            for size in np.unique(length):
                (rows,) = np.nonzero(length == size)
                step = max(1, HASH_CHARS // int(size))
                for start in range(0, len(rows), step):
                    part = rows[start : start + step]
                    chars = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), size).astype(np.uint64)
                    keys = deletion_keys(chars).view(np.int64).ravel()
                    at = np.tile(np.append(np.arange(size, dtype=np.int32), np.int32(WHOLE)), len(part))
                    first = np.ones((len(part), size + 1), bool)
                    first[:, 1:-1] = chars[:, 1:] != chars[:, :-1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at), pa.array(np.repeat(wid[part], size + 1)), pa.array(first.ravel())], ["key", "at", "wid", "first"])

    return pick(words, "wid", "word").mapInArrow(run, "key bigint, at int, wid bigint, first boolean")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Of the keys those that words share, as (at, wid, other): with ``other`` null the
    words that have one key at one place; else a deletion's word and the word that it
    may give.  Each appears once for a key."""
    arrow_rows(keys.sparkSession, 65_536)

    def links(key: np.ndarray, at: np.ndarray, wid: np.ndarray, leads: np.ndarray) -> pa.RecordBatch:
        """Of whole groups, in order of (key, at, wid)."""
        new_key = np.append(True, key[1:] != key[:-1])
        new_place = new_key | np.append(True, at[1:] != at[:-1])
        group = np.cumsum(new_place) - 1
        size = np.bincount(group)
        deleted = at != WHOLE
        same = deleted & (size[group] > 1)
        # the whole words of a key come first in it; there is one, but for collisions
        first = np.flatnonzero(new_key)
        of_key = np.cumsum(new_key) - 1
        whole = np.bincount(of_key, weights=~deleted).astype(np.int64)
        n = np.where(deleted & leads, whole[of_key], 0)
        rows = np.repeat(np.arange(len(key)), n)
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        other = wid[first[of_key[rows]] + turn]
        of_place = np.flatnonzero(same)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[of_place], key[rows]])),
                pa.array(np.concatenate([at[of_place], at[rows]])),
                pa.array(np.concatenate([wid[of_place], wid[rows]])),
                pa.concat_arrays([pa.nulls(len(of_place), pa.int64()), pa.array(other, pa.int64())]),
            ],
            ["key", "at", "wid", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("spelling")
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)]
        for b in batches:
            held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            begin = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if begin:
                yield links(*[h[:begin] for h in held])
                held = [h[begin:] for h in held]
        if len(held[0]):
            yield links(*held)

    dealt = keys.repartition(F.shiftright("key", 48)).sortWithinPartitions("key", "at", "wid")
    return dealt.mapInArrow(run, "key bigint, at int, wid bigint, other bigint")


def _without(word: str, at: str):
    """The word without the character at a place counted from 0."""
    return F.expr(f"concat(substring({word}, 1, {at}), substring({word}, {at} + 2))")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best): how many near words each of ``words`` (wid, word, n) has, and the
    heaviest (struct of minus its number, and the word); words without one have no row."""
    found = stored(shared_keys(keys_of(words)), "shared")
    known = words.select("wid", "word", "n")
    best = F.struct((-F.col("n")).alias("minus"), "word")
    # one character replaced
    places = found.where("other IS NULL").select("at", "wid").join(known, "wid").select("wid", "at", _without("word", "at").alias("rest"), best.alias("own"))
    by_place = Window.partitionBy("rest", "at").orderBy("own")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = places.select("wid", "own", F.count("*").over(whole).alias("g"), F.first("own").over(whole).alias("first"), F.nth_value("own", 2).over(whole).alias("second"))
    replaced = ranked.where("g > 1").select("wid", (F.col("g") - 1).alias("n_near"), F.when(F.col("first") == F.col("own"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # one character more or less
    longer = found.where("other IS NOT NULL").select("wid", "other", "at")
    short = known.select(F.col("wid").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    pairs = longer.join(known, "wid").join(short, "other").where(_without("word", "at") == F.col("other_word"))
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("wid").alias("wid"), F.lit(1).cast("bigint").alias("n_near"), F.struct((-F.col("other_n")).alias("minus"), F.col("other_word").alias("word")).alias("best")),
        F.struct(F.col("other").alias("wid"), F.lit(1).cast("bigint").alias("n_near"), best.alias("best")),
    )))
    return replaced.unionByName(both).groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: the last word that forms lead to."""
    step = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    for _ in range(DOUBLINGS):
        after = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(step.select("word", "root").join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return step


def group_variants(counts: DataFrame) -> DataFrame:
    """Near words, form and root of each of ``counts`` (word, n, no word twice)."""
    words = stored(counts.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    near = words.join(near_words(words), "wid", "left")
    heavy = -F.col("best.minus") >= RATIO * F.col("n")
    forms = near.select("word", F.when(heavy, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(heavy, -F.col("best.minus")).alias("form_n"))
    forms = stored(forms, "near")
    return forms.join(with_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The words of documents that occur often enough, each with its variants' heads."""
    return group_variants(word_counts(docs).where(F.col("n") >= LEAST_N))
