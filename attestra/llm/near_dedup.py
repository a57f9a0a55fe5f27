"""Near-duplicate detection with BagMinHash signatures.

Weights are the multiplicities of a text's five-word shingles.  Per shingle,
the weight axis is cut at 0, 1, 2, 4, 8, ...; each interval has a Poisson
process seeded by shingle and interval, whose points carry a time, a register
and a path of bits.  Each bit halves the interval, so a path ends in one cell of
weight 1, and a text sees a point if its weight reaches that cell: two texts see
the same points below the smaller of their weights.  A register keeps its
earliest point, hence two texts agree in a register with probability equal to
their weighted Jaccard similarity.  A process is left once its points are later
than the latest of the text's registers.

Signatures are cut into bands; texts that share a band are candidates and are
verified by exact multiset overlap.  A bucket is never expanded into all its
pairs: its members are compared with one pivot, the member with the most
companions in all its buckets, and verified links are united.  Members of a
bucket that still belong to different components are *open*; what is left out
so far could only link texts that are in one class already.

Open texts meet in an exact join: shingles are counted over all open texts and
ordered from rare to frequent, and a pair of similarity 0.8 must share one among the first of both texts.  A
text sends one row for each of its first shingles that others hold too, a fifth
of its words at most; which of them count for a partner follows from the place
of the shingle and both sizes.  The shingles that a whole group has in common
come last and are left out, so that copies of one source which are too different
from each other don't meet in pairs.  Rows of hot shingles are spread over many
tasks.

A family of texts just under and over the similarity would still meet in pairs.
While the join would send more than ``ROUND_PAIRS`` pairs for each open text, the
members of a key are first dealt to cells of about ``CELL`` texts, another deal
each round, and compared with one member of their cell; links found close classes,
and with them the buckets that keep texts open.  A round sends one pair for each
row at most.  The join takes what is open once a round leaves more than half of
the pairs to send, so that rounds save work and decide nothing.  Where that is still many pairs, each open
text is held against the pivot that most of its companions know: what it lacks of
the pivot and has beyond it are its changes, and two texts that both differ from
the pivot are similar only if they share enough changes.  A bit field of the
changes bounds from above how many they can share, inside the join, so that texts
which differ from their source in different places are not sent at all.

A text pair of similarity 0.8 shares no band with probability 3e-6 (32 bands of
5 registers).

Defined results: equal texts form one node before anything else; texts of fewer
words than a shingle are one shingle; texts without words match only equal
texts; rows with a null id get a null class; null text counts as empty; a class
is named by its smallest id.  Different texts under one id are judged each on
its own (two classes may then have one name).  Very long texts are read whole;
an empty table has no classes.  Extra columns are ignored, or kept by
``one_per_class``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, byte_slices, fresh, hot_keys, pick, salted_join, stored, take_worker
from .components import components
from .decontaminate import words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, WIDTH = 32, 5
REGISTERS = BANDS * WIDTH
#: Pairs for each open text from which rounds of comparisons come before the join
#: of what is open, and the texts of a key that share one cell of a round.
ROUND_PAIRS, CELL = 8, 8
#: Numbers of 64 bits in the bit field of a text's changes; a text with more than
#: ``MOST_CHANGES`` has none, and its pairs are all compared.
FIELD, MOST_CHANGES = 32, 512

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers over 0 and up to 1."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingle_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted by text and shingle."""
    each = [words(t) for t in texts]
    size = np.array([len(w) for w in each], np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for ws in each for w in ws), np.uint64, int(size.sum()))
    h = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    of = np.repeat(np.arange(len(texts)), size)
    ends = np.cumsum(size)
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    first = np.arange(len(of)) - np.repeat(ends - size, size) < np.repeat(count, size)
    at = np.flatnonzero(first)
    of = of[at]
    room = ends[of] - at
    total = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        total = mix(total * U(0x9E3779B97F4A7C15) + np.where(j < room, h[at + j], U(0)))
    key = (of.astype(np.uint64) << U(44)) | (total >> U(20))
    key, n = np.unique(key, return_counts=True)
    return (key >> U(44)).astype(np.int64), key & U((1 << 44) - 1), n


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """BagMinHash registers of each text (infinite without words), and sizes."""
    of, shingle, n = shingle_counts(texts)
    sizes = np.bincount(of, n, len(texts)).astype(np.int64)
    registers = np.full(len(texts) * REGISTERS, np.inf)
    parts, level = [], 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        has = n > low
        if not has.any():
            break
        width = max(low, 1)
        parts.append((of[has], mix(shingle[has] + U((level + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)), np.full(has.sum(), width), np.minimum(n[has] - low, width)))
        level += 1
    if not parts:
        return registers.reshape(-1, REGISTERS), sizes
    of, state, width, reach = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(of))
    while len(of):
        state = mix(state + U(0x9E3779B97F4A7C15))
        time = time - np.log(unit(state)) / (width * REGISTERS)
        latest = registers.reshape(-1, REGISTERS).max(1)
        on = time < latest[of]
        if not on.all():
            of, state, width, reach, time = of[on], state[on], width[on], reach[on], time[on]
        draw = mix(state ^ U(0xD1B54A32D192ED03))
        place = of * REGISTERS + (draw % U(REGISTERS)).astype(np.int64)
        seen = reach == width
        if seen.all():
            np.minimum.at(registers, place, time)
        else:
            # the width is a power of two: each bit of the path halves what is left of the interval, down to a cell
            cell = mix(draw) & (width - 1).astype(np.uint64)
            seen |= cell < reach.astype(np.uint64)
            np.minimum.at(registers, place[seen], time[seen])
    return registers.reshape(-1, REGISTERS), sizes


def band_keys(registers: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), BANDS, WIDTH)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), 1))
    for j in range(WIDTH):
        key = mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard similarity of two sorted (shingle, count) pairs."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, bands) of every row with an id."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("near")
        for b in batches:
            texts = b.column(1).to_pylist()
            registers, sizes = signatures(texts)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(registers).ravel()), BANDS).cast(pa.list_(pa.int64()))
            digests = [hashlib.md5((t or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), pa.array(sizes), bands], ["doc_id", "digest", "size", "bands"])

    return stored(pick(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, digest string, size bigint, bands array<bigint>"), "sketch")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.  b is the pivot: rows
    of one pivot come together, so its shingles are counted once."""
    left = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").hint("merge")
    rows = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("near")
        pivot, counts = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1).to_pylist()
            of, shingle, n = shingle_counts(batch.column(2).to_pylist())
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
            keep = []
            for k in range(batch.num_rows):
                if b[k] != pivot:
                    _, s, c = shingle_counts([batch.column(3)[k].as_py()])
                    pivot, counts = b[k], (s, c)
                mine = slice(cut[k], cut[k + 1])
                keep.append(similarity((shingle[mine], n[mine]), counts) >= SIMILARITY)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    arrow_rows(pairs.sparkSession, 256)
    return stored(rows.mapInArrow(run, "a bigint, b bigint"), "verified")


def prefix_rows(texts: DataFrame) -> DataFrame:
    """(key, node, place), one for each first shingle of a text (node, text)
    that other texts hold too; place is the text's size and the shingle's place.
    Shingles are counted exactly, at any size of the table: only those of several
    texts go on, and what a text has alone stands before them.  A text's first
    shingles are those that can be the first it shares with a similar text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("near")
        for batch in batches:
            for b in byte_slices(batch, 1):
                of, shingle, n = shingle_counts(b.column(1).to_pylist())
                size = np.bincount(of, n, b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), b.column(0).take(pa.array(of)), pa.array(n + (size[of] << 32))], ["key", "node", "held"])

    each = texts.select("node", "text").mapInArrow(run, "key bigint, node bigint, held bigint")
    shared = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-shingles")
    rows = salted_join(each, shared, "key", hot_keys(shared, "key", "n"), "node")
    size, count = F.shiftright("held", 32), F.col("held").bitwiseAND(F.lit((1 << 32) - 1))
    own = Window.partitionBy("node")
    upto = own.orderBy("n", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a shingle stands for all its copies
    placed = rows.select("key", "node", size.alias("size"), (size - F.sum(count).over(own) + F.sum(count).over(upto) - count).alias("before"))
    least = F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("size") + SIMILARITY * F.col("size")) - 1e-6)
    return stored(placed.where(F.col("before") <= F.col("size") - least).select("key", "node", (F.shiftleft("size", 32) + F.col("before")).alias("place")), "prefixes")


def open_rows(prefixes: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (key, ask, node, label, place) of keys where texts of two labels meet
    and one of them asks, the keys with their counts, and the pairs that the keys
    would send at most.  ``asks`` has (node, label, asks) of the open texts."""
    rows = prefixes.join(asks.select("node", "label", F.col("asks").alias("ask")).hint("merge"), "node")
    rows = stored(rows.select("key", "ask", "node", "label", "place"), "open-rows")
    per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("ask").alias("asking"), (F.min("label") < F.max("label")).alias("mixed"))
    per_key = stored(per_key.where("asking > 0 and mixed").select("key", "n", "asking"), "prefix-keys")
    most = per_key.agg(F.sum(F.col("n") * F.col("asking"))).first()[0] or 0
    return rows.join(per_key.select("key"), "key", "left_semi"), per_key, most


def able():
    """Whether a shared first shingle leaves u and v (label, place) a chance:
    what follows it must be long enough in both for the overlap they need."""
    u_size, v_size = F.shiftright("u_at", 32), F.shiftright("v_at", 32)
    low = F.lit((1 << 32) - 1)
    return (F.col("u_label") != F.col("v_label")) & (F.col("u_at").bitwiseAND(low) <= u_size - _overlap()) & (F.col("v_at").bitwiseAND(low) <= v_size - _overlap()) & (F.least(u_size, v_size) >= F.lit(SIMILARITY * (1 - 1e-9)) * F.greatest(u_size, v_size))


def _overlap():
    return F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.shiftright("u_at", 32) + F.shiftright("v_at", 32)) - 1e-6)


def able_changes():
    """Whether the changes of u and v from one pivot leave them a chance.  They
    share what the pivot has and neither lacks, and the changes common to both:
    a bit that only one field has is a change that is not common."""
    u, v = (F.col(f"{x}_changes") for x in "uv")

    def alone(x, y):
        return sum((F.bit_count(x[f"b{k}"].bitwiseAND(F.bitwise_not(y[f"b{k}"]))) for k in range(FIELD)), F.lit(0))

    common = F.least(u["changes"] - alone(u, v), v["changes"] - alone(v, u))
    kept = u["pivot_size"] - u["lacks"] - v["lacks"]
    return F.coalesce((u["pivot"] != v["pivot"]) | (kept + common >= _overlap()), F.lit(True))


def changes(asks: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, changes) of the open texts with few changes from the pivot that
    most rows of the buckets have, of those in the text's own buckets."""
    known = members.select("node", F.col("pivot.node").alias("pivot"))
    rows = known.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    known = known.join(asks.select("node"), "node", "left_semi")
    known = salted_join(known, rows, "pivot", hot_keys(rows, "pivot", "n"), "node")
    chosen = known.groupBy("node").agg(F.max(F.struct("n", "pivot")).alias("p")).select("node", "p.pivot")
    mine = chosen.hint("merge").join(texts, "node").hint("merge")
    both = mine.join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot").select("node", "pivot", "text", "pivot_text")
    names = ["node", "pivot", "pivot_size", "lacks", "changes", *(f"b{k}" for k in range(FIELD))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("near")
        pivot, held = None, None
        for batch in batches:
            of, shingle, n = shingle_counts(batch.column(2).to_pylist())
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
            out = []
            for k, (node, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if other != pivot:
                    pivot, (_, *held) = other, shingle_counts([batch.column(3)[k].as_py()])
                mine = slice(cut[k], cut[k + 1])
                every = np.concatenate([shingle[mine], held[0]])
                ids, at = np.unique(every, return_inverse=True)
                over = np.bincount(at, np.concatenate([n[mine], -held[1]]), len(ids)).astype(np.int64)
                lacks, total = int(-over[over < 0].sum()), int(np.abs(over).sum())
                if total <= MOST_CHANGES:
                    bits = mix(ids[over != 0] * U(2) + (over[over != 0] > 0).astype(np.uint64)) % U(64 * FIELD)
                    field = np.zeros(FIELD, np.uint64)
                    np.bitwise_or.at(field, (bits >> U(6)).astype(np.int64), U(1) << (bits & U(63)))
                    out.append((node, other, int(held[1].sum()), lacks, total, *field.view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    arrow_rows(asks.sparkSession, 256)
    found = stored(both.mapInArrow(run, ", ".join(f"{c} bigint" for c in names)), "changes")
    return found.select("node", F.struct(*names[1:]).alias("changed"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def prefix_pairs(alive: DataFrame, per_key: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """All pairs (a < b) of open texts with different labels, at least one of
    which asks, that can be similar enough; also by their changes, if given."""
    may = able()
    if changed is not None:
        alive, may = stored(alive.hint("merge").join(changed, "node", "left"), "alive"), may & able_changes()
    more = ["changed"] if changed is not None else []

    def side(x: str) -> list:
        return ["key", F.col("node").alias(x), F.col("label").alias(f"{x}_label"), F.col("place").alias(f"{x}_at"), *(F.col(c).alias(f"{x}_changes") for c in more)]

    return _ordered(salted_join(alive.where("ask").select(*side("u")), alive.select(*side("v")), "key", hot_keys(per_key, "key", "n"), "u").where(may))


def cell_pairs(alive: DataFrame, per_key: DataFrame, nth: int) -> DataFrame:
    """Pairs (a < b) of each open text with one member of its cell in each key,
    for the deal of the nth round.  Cells stay small, however many rows a key has."""
    cells = per_key.select("key", F.ceil(F.col("n") / CELL).alias("cells"))
    dealt = salted_join(alive, cells, "key", hot_keys(per_key, "key", "n"), "node")
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(nth)), F.col("cells"))).drop("cells")
    middle = F.max_by(F.struct(F.col("node").alias("v"), F.col("label").alias("v_label"), F.col("place").alias("v_at")), F.xxhash64("node", F.lit(-nth)))
    pivots = dealt.groupBy("key", "cell").agg(middle.alias("p")).select("key", "cell", "p.*")
    rows = dealt.select("key", "cell", F.col("node").alias("u"), F.col("label").alias("u_label"), F.col("place").alias("u_at"))
    return _ordered(rows.join(pivots, ["key", "cell"]).where((F.col("u") != F.col("v")) & able()))


def asking(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, asks) of the texts in buckets that hold two labels yet; all
    but those of the label that has most of the bucket ask."""
    labelled = members.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    open_ = stored(labelled.join(mixed, "band", "left_semi"), "open")
    largest = open_.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"))
    return stored(open_.join(largest, "band").groupBy("node").agg(F.max("label").alias("label"), F.max(F.col("label") != F.col("top.label")).alias("asks")), "asks")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) between two classes, with the classes (low, high)."""
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("of_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("of_b"))
    x, y = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    return pairs.join(of[0], "a", "left").join(of[1], "b", "left").where(x != y).select("a", "b", F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))


def resolved(members: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label) of all linked texts: the links among ``pairs``, then those
    of open texts, in rounds of cells as long as they pay, then exactly."""
    links = verified(pairs, texts)
    labels = components(links)
    done = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "done")
    prefixes, nth, before = None, 0, float("inf")
    while True:
        asks = asking(members, labels)
        count = asks.count()
        if not count:
            return labels
        if prefixes is None:
            prefixes = prefix_rows(stored(asks.hint("merge").join(texts, "node").select("node", "text"), "open-texts"))
        alive, per_key, most = open_rows(prefixes, asks)
        last = most <= ROUND_PAIRS * count or most > before / 2
        nth, before = nth + 1, most
        if last:
            new = prefix_pairs(alive, per_key, changes(asks, members, texts) if most > ROUND_PAIRS * count else None)
        else:
            new = cell_pairs(alive, per_key, nth)
        new = stored(new.join(done, ["a", "b"], "left_anti"), "pairs")
        if last and new.count() > count:
            # one pair for each two classes first: its link spares the others
            least = F.min_by(F.struct("a", "b"), F.xxhash64("a", "b"))
            one = stored(across(new, labels).groupBy("low", "high").agg(least.alias("p")).select("p.a", "p.b"), "pairs")
            links = links.union(verified(one, texts))
            labels = components(links)
            new = stored(across(new.join(one, ["a", "b"], "left_anti"), labels).select("a", "b"), "pairs")
        found = verified(new, texts)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
        if last:
            return labels
        done = done.union(new)


def named_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest) with an id, and a table (digest, doc_id, node,
    class, name): for each distinct text its smallest id, and a number and the
    smallest id of its class."""
    rows = sketch(docs)
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers that hold once they are written
    members = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(members.join(shared, "band"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("companions"))
    pivots = members.join(central, "node").groupBy("band").agg(F.max(F.struct("companions", (-F.col("node")).alias("first"), "size")).alias("p")).select("band", F.struct((-F.col("p.first")).alias("node"), F.col("p.size").alias("size")).alias("pivot"))
    members = stored(members.drop("n").join(pivots, "band"), "members")

    def worth(size_a, size_b):
        return F.least(size_a, size_b) >= SIMILARITY * F.greatest(size_a, size_b)

    wanted = nodes.select("doc_id", "digest", "node").join(members.select("node").distinct(), "node", "left_semi").hint("merge")  # the same plan at every size
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    texts = stored(texts.join(wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("node", "text"), "texts")
    pairs = stored(members.where((F.col("node") != F.col("pivot.node")) & worth(F.col("size"), F.col("pivot.size"))).select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct(), "pairs")
    labels = resolved(members, texts, pairs)
    arrow_rows(docs.sparkSession)
    known = nodes.select("digest", "doc_id", "node")
    linked = known.join(labels, "node")
    names = stored(linked.groupBy("label").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("n")), "names")
    linked = salted_join(linked, names.select("label", "name"), "label", hot_keys(names, "label", "n"), "node")
    alone = known.join(labels, "node", "left_anti")
    return rows.select("doc_id", "digest"), linked.select("digest", "doc_id", "node", F.col("label").alias("class"), "name").unionByName(alone.select("digest", "doc_id", "node", F.col("node").alias("class"), F.col("doc_id").alias("name")))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id), one row for each row of ``docs``."""
    rows, named = named_classes(docs)
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(rows, named.select("digest", F.col("name").alias("class_id")), "digest", hot_keys(copies, "digest", "n"), "doc_id").select("doc_id", "class_id")
    lost = pick(docs, "doc_id").where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(lost)


def one_per_class(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, for each class: that of the
    smallest id, then of the smallest digest; of repeated rows of it the first
    by the other columns.  Rows without an id stay."""
    _, named = named_classes(docs)
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("k"))
    at, digest, nth, other = (fresh(docs, c) for c in ("kept_id", "kept_digest", "kept_nth", "kept_order"))
    kept = first.select(F.col("k.doc_id").alias(at), F.col("k.digest").alias(digest))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where("doc_id is not null").withColumn(at, F.col("doc_id")).withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = rows.join(kept, [at, digest], "left_semi").withColumn(other, F.to_json(F.struct(*[c for c, x in zip(columns, docs.columns, strict=True) if x not in ("doc_id", "text")], F.lit(0).alias(other))))
    ordered = rows.withColumn(nth, F.row_number().over(Window.partitionBy(at, digest).orderBy(F.col(other), F.col("text").isNull())))
    return ordered.where(F.col(nth) == 1).select(*columns).unionByName(docs.where("doc_id is null"))
