"""Toxicity by weak supervision.

1. Terms (words, and word beginnings of four to six letters) that set toxic
   texts apart are counted over all labelled training rows; the surest are dealt
   to ``LEXICONS`` lexicon voters.  A seed list and patterns are further voters.
2. Every document is voted on.  A generative label model with one hidden class
   per document is fitted by expectation maximisation to the counts of all vote
   patterns.  It holds how often each voter fires in either class (its accuracy)
   and, along the tree of the pairs of voters that depend on each other most
   within the classes, how often it fires given the other voter (their
   correlation), so voters that repeat each other don't count twice.  Labels of
   the fourth training fold only anchor the classes while rates are estimated.
3. A linear classifier over term presence is trained on posterior labels: what
   the label model says of the votes alone, labelled or not, over a bounded
   sample of all documents outside the held-out fold.  Its output is the score.

Bounds: the classifier's sample holds at most ``TOXIC_ROWS`` documents that the
label model takes for toxic and ``CLEAN_ROWS`` others (by hash of the id);
everything else covers all documents and all labelled rows.  No label outside
the training fold is read, and nothing but the text enters a score.

Defined results: null texts count as empty, empty texts get the classifier's
base rate; very long texts are read whole; of contradicting labels of one id the
higher counts; without labels the seed list and the patterns alone vote;
repeated documents get equal scores; an empty table gives no rows.  Extra
columns are ignored, or kept by ``without_toxic``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, fresh, pick, stored, take_worker

TOXIC_ROWS, CLEAN_ROWS = 2500, 3500
LEXICONS, TERMS, FEATURES = 32, 512, 3000
LEAST_DOCUMENTS = 4
#: Labels of these folds find the terms, those of the others anchor the classes:
#: a term that stands out by chance in the first is seen through in the second.
#: Fold 0 is held out.
TERM_FOLDS, ANCHOR_FOLDS = (1, 2, 3), (4,)
SEED = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
#: Patterns over lower-case text, each with the parts of which it needs one.
PATTERNS = (
    (r"!{2,}", ("!!",)),
    (r"\b(?:you|thou)(?:'re| are)? (?:an? )?(?:complete |total |such )?\w+ (?:idiot|fool|liar)", ("idiot", "fool", "liar")),
    (r"\b\w+\*{2,}\w*", ("**",)),
    (r"\b(?:shut up|go away|get lost|hate you)\b", ("shut up", "go away", "get lost", "hate you")),
    (r"(?:\b\w+\b)(?: \w+){0,3} (?:idiot|moron|scum|loser)s?\b", ("idiot", "moron", "scum", "loser")),
    (r"\?!|!\?", ("?!", "!?")),
)
#: The last voter: a word that holds a letter four times in a row.
STRETCHED = re.compile(r"(\w)\1{3,}")
CACHE = 100_000
#: Standard errors below the estimate that the lower bound of a term lies; there
#: are very many terms, so some stand out by chance.  Chosen among 1.6, 2.0, 2.3, 2.6 and
#: 3.0 by the log loss on training fold 4 of models that saw folds 1 to 3 alone.
SURE = 1.6
#: Terms that a task counts before it hands its counts on.
COUNTED = 200_000

WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def terms(word: str) -> Iterable[str]:
    """The word itself and its beginnings (marked by a final dash)."""
    yield word
    for n in (4, 5, 6):
        if len(word) >= n:
            yield word[:n] + "-"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


class Lexicon:
    """Numbers of known terms in a text, with a table of words already seen."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.number

    def __setstate__(self, number):
        self.__init__(number)

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        seen = self.seen
        for w in words(text):
            found = seen.get(w)
            if found is None:
                if len(seen) > CACHE:
                    seen.clear()
                found = seen[w] = tuple(self.number[t] for t in terms(w) if t in self.number)
            if found:
                out.update(found)
        return out


class Voters:
    """Lexicon voters, then patterns and stretched words; bit k of a mask is voter k."""

    def __init__(self, lexicons: list[list[str]]) -> None:
        self.bits = {t: 1 << k for k, voter in enumerate(lexicons) for t in voter}
        self.first = len(lexicons)
        self.count = len(lexicons) + len(PATTERNS) + 1
        self.patterns = [(re.compile(p), parts) for p, parts in PATTERNS]
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        mask = 1 << (self.count - 1) if STRETCHED.search(word) else 0
        for t in terms(word):
            mask |= self.bits.get(t, 0)
        return mask

    def mask(self, text: str | None) -> int:
        if not text:
            return 0
        low, seen, mask = text.lower(), self.seen, 0
        if len(seen) > CACHE:
            seen.clear()
        for w in set(WORD.findall(low)):
            bits = seen.get(w)
            if bits is None:
                bits = seen[w] = self.word(w)
            mask |= bits
        for k, (p, parts) in enumerate(self.patterns):
            if any(x in low for x in parts) and p.search(low):
                mask |= 1 << (self.first + k)
        return mask


def train_labels(labels: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    known = pick(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")).isin(*folds))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def ranked_terms(docs: DataFrame, labels: DataFrame, most: int = FEATURES) -> list[str]:
    """The terms that mark toxic texts most surely (by a lower bound of their
    log-odds, where it is positive), counted over all labelled rows of their folds."""
    known = train_labels(labels, TERM_FOLDS).hint("merge")  # the same plan at every size
    rows = pick(docs, "doc_id", "text").where(fold(F.col("doc_id")).isin(*TERM_FOLDS)).join(known, "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        count: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def told() -> Iterator[pa.RecordBatch]:
            for y, c in enumerate(count):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "toxic", "n"])
                c.clear()

        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = count[int(y > 0)]
                c[""] += 1  # no term is empty: this counts the rows
                c.update({t for w in words(text) for t in terms(w)})
                if len(c) > COUNTED:
                    yield from told()
        yield from told()

    summed = rows.mapInArrow(run, "term string, toxic int, n bigint").groupBy("term").agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("o"))
    summed = stored(summed.where(f"c >= {LEAST_DOCUMENTS} or term = ''"), "terms")
    total = summed.where("term = ''").first()
    if not total or not total["c"]:
        return []
    a, b = F.col("c") + 0.5, F.col("o") + 0.5
    odds = F.log(a / (F.lit(total["c"]) - F.col("c") + 0.5)) - F.log(b / (F.lit(total["o"]) - F.col("o") + 0.5)) - SURE * F.sqrt(1 / a + 1 / b)
    best = summed.where("term != ''").select("term", odds.alias("odds")).where("odds > 0").orderBy(F.desc("odds"), "term").limit(most)
    return [r["term"] for r in best.collect()]


def votes(docs: DataFrame, labels: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, mask, label) of every document; label is -1 where no training
    label is known."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sent.value.mask(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "mask"])

    voted = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, mask bigint")
    return stored(voted.join(train_labels(labels, ANCHOR_FOLDS), "doc_id", "left").select("doc_id", "mask", F.coalesce("toxic", F.lit(-1)).alias("label")), "votes")


def vote_patterns(voted: DataFrame) -> DataFrame:
    """(mask, label, n): how often each pattern of votes occurs."""
    return stored(voted.groupBy("mask", "label").agg(F.count(F.lit(1)).alias("n")), "patterns")


class LabelModel:
    """Share of the toxic class, firing rates of the voters by class, and the
    firing rates given another voter, along a tree of dependent voters."""

    def __init__(self, voters: int) -> None:
        self.share = 0.1
        self.fire = np.full((2, voters), 0.02)
        self.fire[1] = 0.2
        self.parent = np.full(voters, -1)
        #: [class, voter, vote of its parent]: how often the voter fires
        self.given = np.repeat(self.fire[:, :, None], 2, 2)

    def logit(self, bits: np.ndarray) -> np.ndarray:
        """Log-odds of the toxic class for rows of votes."""
        on = np.log(self.given[1]) - np.log(self.given[0])
        off = np.log1p(-self.given[1]) - np.log1p(-self.given[0])
        above = np.where(self.parent >= 0, bits[:, self.parent], 0).astype(int)
        k = np.arange(len(self.parent))
        return np.log(self.share) - np.log1p(-self.share) + np.where(bits > 0, on[k, above], off[k, above]).sum(1)

    def posterior(self, mask: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(bits_of(mask, len(self.parent))), -40, 40)))

    def fit(self, patterns: DataFrame, rounds: int = 12) -> LabelModel:
        """The share is that of the anchors, where there are any.  Half of the
        rounds take the voters for independent; then the tree is
        laid, and the other half fits the rates along it."""
        seen = {r["label"]: r["n"] for r in patterns.groupBy(F.signum("label").cast("int").alias("label")).agg(F.sum("n").alias("n")).collect()}
        known = seen.get(0, 0) + seen.get(1, 0)
        # the unlabelled weigh as much as the anchors together, lest the classes drift to another division of them
        weight = min(1.0, known / seen[-1]) if known and seen.get(-1) else 1.0
        for k in range(rounds):
            size, second = self.moments(patterns, weight)
            if size.sum() == 0:
                return self
            self.share = float(np.clip((seen.get(1, 0) + 1) / (known + 2) if known else (size[1] + 1) / (size.sum() + 2), 1e-4, 0.9))
            first = second.diagonal(axis1=1, axis2=2)
            self.fire = np.clip((first + np.array([[0.01], [0.1]])) / (size[:, None] + 1), 1e-5, 1 - 1e-5)
            if k == rounds // 2:
                self.parent = self.tree(size, second)
            for y in (0, 1):
                for v, p in enumerate(self.parent):
                    both, above = (second[y, v, p], first[y, p]) if p >= 0 else (0.0, 0.0)
                    pairs = np.array([first[y, v] - both, both]), np.array([size[y] - above, above])
                    self.given[y, v] = (pairs[0] + self.fire[y, v]) / (pairs[1] + 1) if p >= 0 else self.fire[y, v]
            self.given = np.clip(self.given, 1e-5, 1 - 1e-5)
        return self

    def information(self, size: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Mutual information of each pair of voters within the classes."""
        total = np.zeros(second.shape[1:])
        for y in (0, 1):
            n = max(size[y], 1e-9)
            one = np.clip(second[y].diagonal() / n, 1e-9, 1 - 1e-9)
            both = second[y] / n
            for p, q, r in ((both, one[:, None], one), (one[:, None] - both, one[:, None], 1 - one), (one - both, 1 - one[:, None], one), (1 - one[:, None] - one + both, 1 - one[:, None], 1 - one)):
                p = np.clip(p, 1e-12, None)
                total += size[y] / size.sum() * p * np.log(p / (q * r))
        np.fill_diagonal(total, 0)
        return total

    def tree(self, size: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The parent of each voter in the spanning tree of most information."""
        worth = self.information(size, second)
        parent, best, near, inside = np.full(len(worth), -1), worth[0].copy(), np.zeros(len(worth), int), np.zeros(len(worth), bool)
        inside[0] = True
        for _ in range(len(worth) - 1):
            v = int(np.where(inside, -np.inf, best).argmax())
            parent[v], inside[v] = near[v], True
            closer = worth[v] > best
            best, near = np.where(closer, worth[v], best), np.where(closer, v, near)
        return parent

    def moments(self, patterns: DataFrame, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected class sizes, and sums of pairs of votes by class; rows
        without a label count ``weight`` each."""
        model, v = self, len(self.parent)
        width = 2 + 2 * v * v

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                mask, label, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                p = np.where(label < 0, model.posterior(mask), label > 0)
                bits = bits_of(mask, v)
                n = np.where(label < 0, n * weight, n)
                weights = (n * (1 - p), n * p)
                total += np.concatenate([[w.sum() for w in weights], *(((bits * w[:, None]).T @ bits).ravel() for w in weights)])
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["k", "s"])

        rows = patterns.select("mask", "label", "n").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        total = np.zeros(width)
        for r in rows:
            total[r["k"]] = r["s"]
        return total[:2], total[2:].reshape(2, v, v)


def bits_of(mask: np.ndarray, voters: int) -> np.ndarray:
    return (mask.astype(np.int64)[:, None] >> np.arange(voters) & 1).astype(float)


def posterior_sample(docs: DataFrame, voted: DataFrame, model: LabelModel) -> DataFrame:
    """(doc_id, text, posterior) of a bounded sample of the documents outside the
    held-out fold: what the label model says of their votes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.posterior(b.column(1).to_numpy(zero_copy_only=False)))], ["doc_id", "posterior"])

    judged = voted.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "mask").mapInArrow(run, "doc_id bigint, posterior double")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("posterior"))
    chosen = judged.where("posterior >= 0.5").orderBy(*order).limit(TOXIC_ROWS).unionByName(judged.where("posterior < 0.5").orderBy(*order).limit(CLEAN_ROWS))
    chosen = stored(chosen.groupBy("doc_id").agg(F.max("posterior").alias("posterior")), "chosen")
    return stored(pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")  # at most TOXIC_ROWS + CLEAN_ROWS ids


class Classifier:
    """A logistic model over the presence of terms.  Until it is trained, the
    seed list scores."""

    def __init__(self, names: list[str]) -> None:
        self.lexicon = Lexicon({t: k for k, t in enumerate(names)})
        self.weight = np.array([2.0 if t in SEED else 0.0 for t in names])
        self.bias = -2.5

    def fit(self, rows: list[set[int]], target: np.ndarray, rounds: int = 400, rate: float = 0.5, ridge: float = 0.01) -> Classifier:
        if not rows:
            return self
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([k for r in rows for k in sorted(r)], np.int64)
        share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
        self.weight, self.bias, step = np.zeros(len(self.weight)), float(np.log(share / (1 - share))), np.ones(len(self.weight))
        for _ in range(rounds):
            z = np.bincount(row, self.weight[col], len(rows)) + self.bias
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
            g = np.bincount(col, error[row], len(self.weight)) + ridge * len(rows) / 100 * self.weight
            step += g * g
            self.weight -= rate * g / np.sqrt(step)
            self.bias -= rate * error.mean()
        return self

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weight[k] for k in sorted(self.lexicon.of(text)))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    arrow_rows(docs.sparkSession)
    ranked = ranked_terms(docs, labels)
    marked = ranked[:TERMS]
    # the surer, the fewer terms in one voter
    ends = [round(TERMS * (k / LEXICONS) ** 2) for k in range(LEXICONS + 1)]
    lexicons = [[t for t in marked[a:b] if t not in SEED] for a, b in zip(ends, ends[1:], strict=False)] + [list(SEED)]
    voters = Voters([v for v in lexicons if v])
    voted = votes(docs, labels, voters)
    model = LabelModel(voters.count).fit(vote_patterns(voted))
    classifier = Classifier(list(dict.fromkeys([*SEED, *ranked])))
    found, target = [], []
    for r in posterior_sample(docs, voted, model).orderBy("doc_id", "text").toLocalIterator():
        found.append(classifier.lexicon.of(r["text"]))
        target.append(r["posterior"])
    return classifier.fit(found, np.array(target))


def score_with(docs: DataFrame, classifier: Classifier, column: str) -> DataFrame:
    """``docs`` with the score in a new column, in one narrow pass."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity")
        for b in batches:
            scores = [sent.value.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_with(pick(docs, "doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't judged toxic."""
    score = fresh(docs, "toxic_score")
    return score_with(docs, train(docs, labels), score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
